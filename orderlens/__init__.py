"""Order analytics on Spark: load exports, map, clean, and compute sales metrics."""
