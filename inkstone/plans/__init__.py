"""Queries over the driver tables, one per operator, and their SQL equivalents."""
