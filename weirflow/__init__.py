"""Effect-graph analytics on Spark."""
