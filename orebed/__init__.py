"""orebed: composable PySpark operators for project tables, documents and text."""

__version__ = "0.1.0"
