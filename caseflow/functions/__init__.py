"""Column builders: everything here is a built-in Spark expression, no Python UDF."""
