"""Readers and writers of the text and binary formats."""
