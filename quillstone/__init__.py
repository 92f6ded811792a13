"""Batch question answering and knowledge-base analytics on Spark DataFrames."""
