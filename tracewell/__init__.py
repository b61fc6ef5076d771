"""Case-timeline analytics as Spark jobs."""
