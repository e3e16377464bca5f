"""Spark ML jobs on the feature frame and the panel."""
