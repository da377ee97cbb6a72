"""Readers of experiment files and writers of results."""
