"""siltstone: a document-retrieval and analytics engine expressed as Spark plans."""

__version__ = "0.1.0"
