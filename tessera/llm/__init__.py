"""Operators for building training corpora; nothing else in tessera imports this package."""
