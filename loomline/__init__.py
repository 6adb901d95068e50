"""Evidence-preserving document analytics on Spark DataFrames."""
