"""Incremental maintenance of a join-aggregate query on Spark."""
