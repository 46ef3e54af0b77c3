"""Job-market analytics on Spark: every operator is a function over DataFrames or Columns."""

__version__ = "0.1.0"
