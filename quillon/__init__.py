"""quillon: vector search, versioned-corpus retrieval and corpus processing as plain PySpark."""

__version__ = "0.1.0"
