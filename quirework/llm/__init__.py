"""Operators for preparing text collections for language models. Nothing outside this package imports it."""
