"""Spark-native curation and scoring of chain-of-thought training data."""
