"""Operators for preparing language-model training data, each one a Spark job.

Nothing outside this subpackage imports it: it can be removed as a whole.
"""
