"""Classification-evaluation analytics as Spark jobs."""
