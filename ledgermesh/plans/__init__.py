"""Registered queries over the star-schema tables."""
