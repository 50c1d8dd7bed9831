"""Outcome analytics over activity data, expressed as Spark jobs."""
