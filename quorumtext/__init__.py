"""Spark-native analytics over transcription ensembles."""
