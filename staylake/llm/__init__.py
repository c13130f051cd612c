"""Operators of a training-data pipeline; ``queries.py`` registers them, nothing else in the library imports them."""
