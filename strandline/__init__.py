"""Overlapping message exports, their unique content and their timelines, as Spark DataFrames."""

__version__ = "0.2.0"
