"""Column-level building blocks. Every function returns a Spark ``Column``."""
