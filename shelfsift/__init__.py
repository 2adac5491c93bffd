"""Listing-quality analytics on Spark: find listings stuffed with unrelated search terms."""
