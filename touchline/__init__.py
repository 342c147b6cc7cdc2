"""Spark-native match analytics: event-stream statistics, tracking, association and evaluation."""
