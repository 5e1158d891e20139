"""Readers, writers and shared scratch storage."""
