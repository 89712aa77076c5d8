"""Column expressions, all of them JVM-side."""
