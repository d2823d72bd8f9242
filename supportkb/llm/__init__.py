"""Operators a training-data pipeline needs, one module each; ``queries`` registers them."""
