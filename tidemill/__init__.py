"""Tidemill: link-catalogue processing and training-data operators on Spark DataFrames."""
