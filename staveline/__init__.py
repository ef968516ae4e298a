"""Score-data analytics on PySpark: relational operators for page, staff, token and tablature tables."""

__version__ = "0.1.0"
