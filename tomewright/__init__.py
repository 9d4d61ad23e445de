"""Spark-native engine for versioned documents, full-text search and corpus preparation."""
