"""Spark-first analytics over catalogues, matrices, graphs and event streams."""
