"""Spark-native analytics for versioned machine-learning datasets."""
