"""Ensemble analytics on Spark."""
