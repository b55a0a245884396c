"""trailrank: session recommendation analytics on Spark DataFrames."""
