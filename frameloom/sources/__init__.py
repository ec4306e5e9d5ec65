"""Readers, writers and the table mappings the registered queries use."""
