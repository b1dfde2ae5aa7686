"""Mobility analytics on Spark: demand, supply, segment graphs, partitions and their metrics."""
