"""Customer-feedback analytics as Spark DataFrame operators."""
