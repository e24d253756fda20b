"""Structured Streaming: live acceptance against per-chat marks."""
