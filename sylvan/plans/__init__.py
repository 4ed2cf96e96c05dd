"""The pipeline language and its lowering to lazy DataFrames."""
