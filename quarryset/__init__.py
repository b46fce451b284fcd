"""Keyed data structures, vector retrieval and corpus operators as Spark plans."""
