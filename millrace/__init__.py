"""Spark jobs for points ledgers, price series, model-ready tables and text corpora."""
