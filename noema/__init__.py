"""A Spark-native knowledge analytics engine: retrieval, de-duplication, confidence, graph, categories, time and memory."""
