"""Captures as a stream."""
