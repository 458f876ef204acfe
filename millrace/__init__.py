"""Millrace: table pipelines, SQL transforms and run statistics on Spark DataFrames."""
