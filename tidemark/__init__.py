"""tidemark: panel economics over mixed-frequency market observations, on Spark DataFrames."""
