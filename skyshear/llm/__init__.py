"""Operators for text and vector corpora; nothing outside this folder imports it."""
