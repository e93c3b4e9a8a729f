"""Foliospark: document retrieval, graph analytics and routing, declared on Spark DataFrames."""
