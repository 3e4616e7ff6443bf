"""Operators that prepare text corpora: filters, near duplicates, mixing, packing, sharding and search."""
