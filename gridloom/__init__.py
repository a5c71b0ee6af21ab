"""Spark-native analytics for wide device telemetry."""
