"""Spark-native explainable clustering of knowledge-graph entities."""
