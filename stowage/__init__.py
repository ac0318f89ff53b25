"""stowage: versioned, content-addressed asset collections as Spark DataFrames."""
