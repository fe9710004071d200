"""leakscope: training-data leakage and memorization analytics on Spark."""

__version__ = "0.1.0"
