"""Catalog analytics on Spark: derive, shape and check catalog-style datasets."""
