"""Kindred: string-pair matching and text-corpus analytics on Spark DataFrames."""
