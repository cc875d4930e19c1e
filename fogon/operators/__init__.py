"""Distributed building blocks that Spark does not ship as one call."""
