"""revaudit: relational auditing of text that changes across revisions, as PySpark DataFrame operators."""

__version__ = "0.1.0"
