"""Security-event analytics as Spark DataFrame transforms."""
