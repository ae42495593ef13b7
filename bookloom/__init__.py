"""Bookloom: evidence and replay analytics for order-book feeds, on Spark DataFrames."""
