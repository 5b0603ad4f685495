"""Queries over the engine's tables, each with its SQL equivalent where SQL can say it."""
