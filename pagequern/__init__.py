"""pagequern: analytics over collections of web pages and documents, as Spark DataFrame operators."""

__version__ = "0.1.0"
