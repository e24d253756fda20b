"""Operators for training text: conversations, look-alike text, languages, personal data, packing, leaks, moderation."""
