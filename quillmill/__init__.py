"""Literature analytics on Spark: ingest, structure, search and review scientific papers."""
