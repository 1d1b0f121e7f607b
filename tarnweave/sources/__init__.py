"""Readers and writers of items, pages and files."""
