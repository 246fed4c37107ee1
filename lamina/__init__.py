"""Spark-native clustering of embedding vectors and the texts they come from."""
