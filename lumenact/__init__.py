"""lumenact: molecular activity inference from expression tables, on PySpark DataFrames."""

__version__ = "0.1.0"
