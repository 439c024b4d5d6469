"""Whole plans: the curation pipeline and the query registry."""
