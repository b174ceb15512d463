"""Budgeted hierarchical reduction of texts on Spark, kept up to date by content hashes."""
