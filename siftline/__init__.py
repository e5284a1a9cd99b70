"""Siftline: text and event intelligence on Spark DataFrames."""
