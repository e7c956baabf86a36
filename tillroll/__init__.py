"""Retail sales analytics as lazy Spark DataFrame functions.

Every operator takes DataFrames plus parameters and returns a DataFrame. Nothing here
collects data, runs an action or needs a Python UDF.
"""
