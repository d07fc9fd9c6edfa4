"""Spark-native analytics over corpora of annotated page images."""
