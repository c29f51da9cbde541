"""Dimensional-model inference on Spark: profile, keys, dependencies, joins, models, certification."""
