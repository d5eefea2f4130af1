"""Incremental accumulation of landed files."""
