"""Text formats that land as DataFrames."""
