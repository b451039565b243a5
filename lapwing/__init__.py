"""Catalog deduplication analytics expressed as Spark DataFrame plans."""
