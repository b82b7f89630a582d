"""Incremental pick-up of exported files."""
