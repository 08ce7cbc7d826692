"""Session, co-occurrence and ranking analytics on Spark DataFrames."""
