"""Operators for preparing training data: tokenisers, joins, mixing, filters and archives."""
