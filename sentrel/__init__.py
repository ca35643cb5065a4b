"""Security analytics for industrial networks, built from Spark DataFrames."""
