"""tidewright: a Spark-first engine for multi-asset time series and simulated paths."""

__version__ = "0.1.0"
