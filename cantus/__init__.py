"""Cantus: music-structure analytics on Spark DataFrames, keyed by track."""
