"""Inspection analytics and label-quality operators on Spark DataFrames."""
