"""Streaming state and its batch twins."""
