"""quillon: full-text search and corpus preparation as Spark plans."""
