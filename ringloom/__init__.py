"""Spark-first analytics over byte streams, token sequences and relational tables."""
