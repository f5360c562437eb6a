"""Spark-native motion and trajectory analytics."""
