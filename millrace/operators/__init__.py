"""Operators on DataFrames: contracts, relational helpers, event-time windows, merges, control state."""
