"""Network-flow graph analytics on Spark DataFrames and Structured Streaming."""
