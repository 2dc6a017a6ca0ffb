"""tracemill: trace, event and frame analytics on Spark DataFrames."""
