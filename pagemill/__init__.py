"""Document analytics on Spark: ingest, chunk, index, retrieve and answer, set at a time."""
