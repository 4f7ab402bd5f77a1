"""Readers, writers and the synthetic panel."""
