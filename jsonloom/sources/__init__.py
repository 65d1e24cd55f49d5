"""Readers and writers for JSON values, raw text, record sequences and event streams."""
