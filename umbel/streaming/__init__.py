"""Structured Streaming jobs over the live-check feed."""
