"""Governance analytics over run logs, issues, metrics, code corpora and code graphs, as Spark DataFrame plans."""
