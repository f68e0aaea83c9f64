"""Demand, fairness and routing analytics on Spark DataFrames."""
