"""Readers, writers and the dataset listing."""
