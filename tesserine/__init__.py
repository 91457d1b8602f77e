"""Corpus analytics on Spark: composable DataFrame operators."""
