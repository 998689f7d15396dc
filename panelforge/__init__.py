"""Cross-sectional panel analytics and formula search on Spark DataFrames."""
