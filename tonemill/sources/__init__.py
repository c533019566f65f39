"""Readers: tolerant delimited files and the parquet test tables."""
