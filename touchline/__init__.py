"""Event-sequence analytics as Spark DataFrame operators."""
