"""Column-level helpers. Everything here returns Spark Column expressions."""
