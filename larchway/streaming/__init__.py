"""Structured Streaming capture into branches."""
