"""Column-level building blocks (pure Spark SQL expressions, codegen-friendly)."""
