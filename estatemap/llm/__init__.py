"""Operators of a training-data pipeline; see the README for the method of each."""
