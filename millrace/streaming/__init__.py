"""Continuous queries: specifications, the query group, health, replay."""
