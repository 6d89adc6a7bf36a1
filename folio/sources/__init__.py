"""Readers and writers of document formats."""
