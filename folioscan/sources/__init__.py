"""Readers of payload files."""
