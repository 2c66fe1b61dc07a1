"""Spark-native assembly of labelled datasets and measurement of classifier robustness."""
