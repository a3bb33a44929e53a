"""Column expressions: pure, JVM-side, no Python UDF."""
