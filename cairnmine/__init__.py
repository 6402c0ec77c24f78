"""Mining of large graphs, tensors, event streams and time series as Spark DataFrames."""
