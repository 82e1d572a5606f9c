"""Registered queries: a Spark callable beside its SQL over the same tables."""

from __future__ import annotations

from .registry import QUERIES, SQL

from . import algebra, contacts, files, matrix, peaks, position, reads, signal, targets  # noqa: E402,F401  (registration)

__all__ = ["QUERIES", "SQL"]
