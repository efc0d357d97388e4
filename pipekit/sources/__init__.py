"""Readers: files, object stores, databases, streams."""
