"""Text analytics and record linkage as Spark DataFrame jobs."""
