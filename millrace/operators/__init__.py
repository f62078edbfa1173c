"""Relational operators: functions from DataFrames to DataFrames, for ``df.transform`` or the builder."""
