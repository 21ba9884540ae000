"""Readers and writers for catalogues, key files and designs."""
