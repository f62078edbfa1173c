"""Checks, metrics, profiles, anomalies and drift, each compiled to few aggregations."""
