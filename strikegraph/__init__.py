"""Outstanding-fact mining over typed knowledge graphs, on Spark DataFrames."""
