"""Record pipelines as Spark DataFrames."""
