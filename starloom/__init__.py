"""Spark-first dimensional warehouse engine: extract, clean, conform, deliver, serve."""
