"""Spark-native engine for selecting, routing, reshaping and enriching semi-structured records."""

__version__ = "0.1.0"
