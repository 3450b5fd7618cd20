"""Text classification and classifier monitoring on Spark DataFrames and streams."""
