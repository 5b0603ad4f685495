"""Structured Streaming jobs over the event table, and their batch twins."""
