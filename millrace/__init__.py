"""Spark-native text retrieval, conversation-state, curation and evaluation analytics."""
