"""Motion and interval analytics on Spark."""
