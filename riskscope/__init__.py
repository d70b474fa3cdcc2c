"""Change-risk analytics, corpus retrieval and test planning over Spark DataFrames."""
