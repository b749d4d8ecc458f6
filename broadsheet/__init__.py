"""Text analytics over a dated article archive, expressed as Spark jobs."""
