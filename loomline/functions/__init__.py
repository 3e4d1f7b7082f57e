"""Column expressions: everything here stays in the JVM and inside whole-stage code generation."""
