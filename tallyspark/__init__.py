"""Spark-native evaluation of structured extraction, and corpus analytics."""
