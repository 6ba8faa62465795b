"""quire: document-corpus analytics expressed as Spark plans."""
