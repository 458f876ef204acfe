"""Transforms: each builder returns a ``DataFrame -> DataFrame`` function."""
