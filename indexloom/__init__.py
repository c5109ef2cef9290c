"""Index compression analytics on DataFrames."""
