"""Operators that prepare a training corpus from collected articles."""
