"""lexmill: corpus, token and vocabulary analytics as Spark DataFrame operators."""
