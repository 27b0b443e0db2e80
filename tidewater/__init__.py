"""Spark-first analytics over bank accounts and money transfers."""
