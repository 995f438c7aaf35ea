"""Paddock: competition-results analytics as composable Spark DataFrame transformations."""
