"""Distributed analytics over sequencing reads on Spark DataFrames."""
