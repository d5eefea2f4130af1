"""Data jobs on tables, time series, text and signals, expressed as Spark plans."""
