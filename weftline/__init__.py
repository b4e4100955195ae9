"""Weftline: graph, retrieval and corpus analytics on PySpark DataFrames."""
