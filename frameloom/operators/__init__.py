"""Relational operators: pure functions from DataFrame to DataFrame."""
