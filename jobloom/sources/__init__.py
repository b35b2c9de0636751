"""Readers of landed payloads: tables, feeds and HTML."""
