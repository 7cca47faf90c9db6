"""Web-text analytics as Spark DataFrame operators."""
