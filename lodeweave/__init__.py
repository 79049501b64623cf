"""Spark-first analytics over code graphs, vectors and documents."""
