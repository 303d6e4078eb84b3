"""Registered queries over the shared tables."""
