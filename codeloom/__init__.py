"""codeloom: graph analytics over relational data, on PySpark DataFrames."""

__version__ = "0.1.0"
