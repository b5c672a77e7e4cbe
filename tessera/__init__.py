"""Bill-of-materials analytics and training-data operators on Spark DataFrames."""
