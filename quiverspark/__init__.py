"""quiverspark: a property-graph and vector analytics engine on PySpark DataFrames."""

__version__ = "0.1.0"
