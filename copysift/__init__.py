"""Finds repeated and near-repeated blocks of code and text with Spark DataFrames, and ranks what they cost."""
