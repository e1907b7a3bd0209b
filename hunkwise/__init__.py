"""Diff analytics on Spark: unified diffs as DataFrames."""
