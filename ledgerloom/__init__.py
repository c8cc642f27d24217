"""Ledgerloom: multi-source, point-in-time business data on Spark DataFrames."""
