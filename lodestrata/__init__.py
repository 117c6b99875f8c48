"""Spark-native operators for housing, spatial, retrieval and document analytics."""
