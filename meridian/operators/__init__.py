"""Relational and analytic operators over DataFrames."""
