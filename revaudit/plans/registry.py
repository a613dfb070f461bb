"""Every query by name, with the SQL that an independent engine runs for the same rows."""

from __future__ import annotations

from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
