"""tessella: raster and array analytics on Spark DataFrames."""
