"""Spark-native pseudonymisation of text and document records."""
