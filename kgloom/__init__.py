"""Spark-native knowledge-graph features, rule mining and credible classification."""
