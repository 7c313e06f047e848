"""Billing analytics as Spark DataFrame jobs: read cloud cost exports, normalise them to one cost
table, and answer cost questions on it at cluster scale."""

__version__ = "0.1.0"
