"""Queries over a data folder."""
