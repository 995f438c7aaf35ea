"""Whole questions composed of the operators, the adapter to the driver's tables and the catalogue of queries."""
