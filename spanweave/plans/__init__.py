"""Registered queries and physical layouts."""
