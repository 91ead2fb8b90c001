"""Daily-series analytics on Spark: order lines in, features, backtests and forecasts out."""

__version__ = "0.1.0"
