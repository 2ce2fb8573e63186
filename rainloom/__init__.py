"""Spark-native analytics over satellite radar precipitation swaths."""
