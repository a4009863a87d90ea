"""tidemark: sample-based data cleaning and approximate analytics on PySpark."""

__version__ = "0.1.0"
