"""Kairograph: a temporal property-graph analytics engine expressed on Spark DataFrames."""
