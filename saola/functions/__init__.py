"""Constant tables and column functions."""
