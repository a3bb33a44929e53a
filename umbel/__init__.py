"""Research-attention analytics as Spark DataFrame jobs."""
