"""Price-observation analytics as Spark DataFrame jobs."""
