"""Bounded and streaming readers, and writers by zone."""
