"""Listing extraction, feature engineering and training-data operators on Spark DataFrames."""
