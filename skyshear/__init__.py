"""Spark-native dual-radar wind analytics."""
