"""Operators on DataFrames: similarity, merging, selection, events, scoring, reports."""
