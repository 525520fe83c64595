"""Operators for large training-data pipelines; nothing else in skein imports this."""
