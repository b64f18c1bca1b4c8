"""Species-distribution data work as Spark DataFrame operators."""
