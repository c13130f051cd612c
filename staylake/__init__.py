"""Hotel booking analytics as Spark DataFrame jobs."""
