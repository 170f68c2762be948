"""Passage retrieval, record analytics and ledger operators on Spark DataFrames."""
