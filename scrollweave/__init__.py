"""Spark-native analytics for scrolling transcripts."""
