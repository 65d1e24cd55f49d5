"""What Spark made of a query."""
