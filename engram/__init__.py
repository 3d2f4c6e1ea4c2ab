"""Memory-graph analytics on Spark: event logs, property graphs, retrieval, metrics."""
