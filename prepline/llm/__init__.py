"""Operators for preparing text corpora and the statistics around them."""
