"""Operators for training-data pipelines of language models. Nothing outside imports this package."""
