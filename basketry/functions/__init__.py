"""Column helpers and the distributed exact quantile."""
