"""Analytics operators: orders, periods, customers, products, ML."""
