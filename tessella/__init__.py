"""Spark-native search for reused token runs, with its analytics."""
