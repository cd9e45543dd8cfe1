"""Siltstone: a Spark-native engine for corpus indexing, retrieval and analytics."""
