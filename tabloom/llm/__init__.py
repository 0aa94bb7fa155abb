"""Operators for text, chat and vector corpora. Nothing else in the library imports this package."""
