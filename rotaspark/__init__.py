"""Evolving sparse-matrix analytics expressed as Spark DataFrame programs."""
