"""Column builders: native expressions, no Python on executors."""
