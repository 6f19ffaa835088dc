"""shelfmark: file-inventory analytics and data reconciliation on PySpark."""

__version__ = "0.1.0"
