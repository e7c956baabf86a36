"""Operators: DataFrames plus parameters in, one lazy DataFrame out."""
