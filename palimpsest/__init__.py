"""Spark-native retrieval, consolidation and corpus analytics over conversational memory."""

__version__ = "0.1.0"
