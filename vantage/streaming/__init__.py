"""Incremental evaluation tables."""
