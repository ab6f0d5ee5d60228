"""Dependency-graph analytics over documents, code signals and tables, on Spark."""
