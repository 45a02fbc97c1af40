"""Readers of feeds and pages, fixtures, and what leaves the engine."""
