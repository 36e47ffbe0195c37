"""Replay and Structured Streaming operators."""
