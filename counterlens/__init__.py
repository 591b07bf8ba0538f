"""Counterfactual evaluation analytics as Spark plans."""
