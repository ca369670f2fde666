"""Review search analytics on Spark: index tables, lookups, codecs, ranking and bulk text operators."""

__version__ = "0.1.0"
