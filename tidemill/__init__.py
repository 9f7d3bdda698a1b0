"""Feed-aggregation analytics on Spark: catalog, planning, parsing, result folding and read models."""
