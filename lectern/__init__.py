"""Spark-native analytics over transcripts and text corpora."""
