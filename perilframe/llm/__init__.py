"""Operators of a training-data pipeline over documents and vectors. Nothing outside this folder imports it."""
