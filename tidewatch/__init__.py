"""Model monitoring, validation and decision analytics as Spark DataFrame operators."""
