"""Record-risk analytics as Spark DataFrame operators."""
