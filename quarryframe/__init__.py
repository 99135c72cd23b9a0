"""Document, text and vector analytics lowered to Spark DataFrames."""
