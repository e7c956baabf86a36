"""Test tables seen as a retail star schema and as raw extracts, in Spark and in SQL."""
