"""loresift: ranked retrieval, corpus maintenance and retrieval evaluation as plain Spark plans."""

__version__ = "0.2.0"
