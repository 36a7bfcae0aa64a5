"""Readers, cleaners and writers."""
