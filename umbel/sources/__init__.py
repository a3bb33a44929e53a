"""Readers with explicit schemas, and sinks."""
