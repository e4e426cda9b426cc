"""Sensitive-text analytics on Spark: detect, score, resolve, search, redact, verify, report."""
