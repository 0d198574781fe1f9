"""panelspark: panel forecasting and portfolio research on Spark DataFrames."""
