"""Evidence-graph analytics and corpus preparation on Spark DataFrames."""
