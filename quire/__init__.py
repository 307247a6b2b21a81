"""quire: document-corpus analytics as plain PySpark DataFrame jobs."""
