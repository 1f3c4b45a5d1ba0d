"""Taxonomic sequence analytics as Spark DataFrame transformations."""

from cladeflow.session import cut_lineage, get_spark, scratch, settle, shared_dir, spread

__all__ = ["cut_lineage", "get_spark", "scratch", "settle", "shared_dir", "spread"]
