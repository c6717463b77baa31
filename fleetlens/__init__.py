"""Transit telemetry analytics expressed as Spark DataFrame jobs."""
