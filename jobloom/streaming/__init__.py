"""Stateful limits over event streams."""
