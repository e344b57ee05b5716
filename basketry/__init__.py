"""basketry: order, customer, product and availability analytics on Spark.

Sub-packages: ``sources`` (tables, adapters, files), ``functions`` (column
helpers, distributed exact quantiles), ``operators`` (the analytics),
``plans`` (registered queries and their SQL oracles), ``streaming``
(file ingest), and the optional ``llm`` (preparation of training text).
"""

__version__ = "0.1.0"
