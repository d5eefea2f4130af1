"""Dataset catalog and ingest jobs over landed payload files."""
