"""Spark-native analytics over indexed entities, edges, events and text."""
