"""Spark-native tables of text and embedding vectors for many tenants."""
