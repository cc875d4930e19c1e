"""DuckDB statements that state the same results as the registered Spark queries."""
