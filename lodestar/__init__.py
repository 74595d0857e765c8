"""Lodestar: a PySpark-native engine for evidence retrieval, ingestion and operations analytics."""
