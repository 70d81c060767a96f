"""Readers, writers and the views on the shared test tables."""
