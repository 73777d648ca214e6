"""Spark-native analytics for measured surfaces and, in ``llm``, for text corpora."""
