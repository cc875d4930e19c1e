"""fogon: star-schema, cube, graph and routing analytics for order data, on Spark DataFrames."""
