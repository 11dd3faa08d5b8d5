"""Document-corpus and translation-memory analytics on Spark."""
