"""Operators for training corpora of language models. Nothing else in the library imports this."""
