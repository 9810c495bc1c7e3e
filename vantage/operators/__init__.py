"""Operators on scenario frames and evaluation tables."""
