"""Spark-first engine for text corpora, token streams, chat data and evaluation metrics."""
