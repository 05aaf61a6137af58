"""Readers and writers: flat CSV staging, parquet tables, and the sample-table mapping."""
