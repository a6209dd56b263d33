"""Retail customer-intelligence and experimentation analytics on Spark DataFrames."""
