"""Bundled tables of fixed public values."""
