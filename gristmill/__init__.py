"""gristmill: content de-duplication and corpus preparation on Spark DataFrames."""
