"""Readers and writers: source tables, lake zones, warehouse, catalog."""
