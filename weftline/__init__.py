"""Spark-native engine for building, cleaning, grouping and evaluating structured-text datasets."""
