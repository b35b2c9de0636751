"""Snapshots of tables, and the registered queries with their SQL."""
