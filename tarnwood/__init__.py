"""Tarnwood: a retrieval and corpus engine on PySpark DataFrames."""
