"""Programme-guide, catalogue and personalisation analytics as Spark DataFrame jobs."""
