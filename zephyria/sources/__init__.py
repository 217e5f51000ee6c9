"""Readers and writers. Every reader declares its schema; nothing is inferred."""
