"""Operators as column expressions and DataFrame functions."""
