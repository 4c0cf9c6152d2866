"""siltstone: search and analytics over text, vectors, graphs and event logs on Spark DataFrames."""
