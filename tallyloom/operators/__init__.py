"""Operators as DataFrame helpers: statistics, keys, pre-aggregates, joins."""
