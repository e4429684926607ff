"""Context-cost analytics over source trees, as Spark DataFrames."""
