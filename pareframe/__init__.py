"""Delta debugging and failure localisation over Spark DataFrames."""
