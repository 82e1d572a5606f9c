"""Readers and writers; every reader returns 0-based half-open coordinates."""
