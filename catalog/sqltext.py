"""Small pieces of DuckDB SQL shared by the oracles."""

from __future__ import annotations

from modelbom.functions.text import WHITESPACE


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CHARS = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def trim_sql(c: str) -> str:
    return f"trim({c}, {_CHARS})"


def nz_sql(c: str) -> str:
    """Trimmed text or NULL."""
    return f"nullif({trim_sql(c)}, '')"
