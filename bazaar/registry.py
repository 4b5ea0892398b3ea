"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from bazaar.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
