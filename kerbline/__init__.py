"""Incident analytics on Spark: cleaning, causal features, panels, metrics, models and rules."""
