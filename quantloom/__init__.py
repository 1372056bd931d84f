"""Point-in-time, cross-sectional panel analytics on Spark DataFrames."""
