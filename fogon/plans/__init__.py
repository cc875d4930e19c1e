"""Star schema, cubes, analyses, checks, graph and routing jobs."""
