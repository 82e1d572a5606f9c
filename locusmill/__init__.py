"""Genomic-interval analytics as Spark DataFrame plans."""
