"""A Spark-first analytics engine for security findings and the corpora they come from."""
