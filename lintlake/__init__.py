"""Code-corpus quality and telemetry analytics as Spark DataFrame jobs."""
