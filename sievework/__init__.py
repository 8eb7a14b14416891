"""Spark jobs for analytics and for preparing training data."""
