"""News clustering and emerging-topic analytics as Spark DataFrame jobs."""
