"""Genotype analytics on Spark DataFrames."""
