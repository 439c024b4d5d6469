"""Corpus engine on Spark."""
