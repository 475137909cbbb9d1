"""Document-collusion screening as Spark DataFrame jobs."""
