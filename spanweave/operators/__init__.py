"""Interval operators over DataFrames."""
