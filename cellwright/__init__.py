"""Spark-native analytics on gridded monthly observations and linked country tables."""
