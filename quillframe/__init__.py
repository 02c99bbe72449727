"""Document-collection analytics as Spark DataFrame operators."""
