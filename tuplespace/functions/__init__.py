"""Column expressions (all native Spark SQL functions, codegen friendly)."""
