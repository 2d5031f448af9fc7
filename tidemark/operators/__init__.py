"""Transforms from DataFrames to DataFrames: event time, aggregation, joins, state, delivery, validation, cluster and metrics."""
