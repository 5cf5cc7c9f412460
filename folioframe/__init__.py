"""Bibliographic record tables on Spark: search, views, sets, citations, exchange formats."""
