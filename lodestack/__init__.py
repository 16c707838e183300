"""Spark-native engine for preference data, rubric scoring and verification."""
