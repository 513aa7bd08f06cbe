"""Column builders: each takes and returns Columns and stays on the JVM."""
