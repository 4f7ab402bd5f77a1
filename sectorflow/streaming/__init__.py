"""Structured Streaming form of the hourly roll-up."""
