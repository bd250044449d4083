"""Segment, roster-matching and contact-log analytics on Spark DataFrames."""
