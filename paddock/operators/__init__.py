"""Transformations DataFrame -> DataFrame. None collects; dates of reference are parameters."""
