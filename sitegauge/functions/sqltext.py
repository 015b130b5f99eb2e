"""Small pieces of SQL text.

Deeply nested array expressions are written as SQL and handed over with one ``F.expr``: that is
one call into the engine instead of hundreds, so large plans are built quickly.
"""

from __future__ import annotations


def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def string_map(entries: dict[str, str]) -> str:
    if not entries:
        return "CAST(map() AS MAP<STRING, STRING>)"
    return "map(" + ", ".join(f"{lit(k)}, CAST({v} AS STRING)" for k, v in entries.items()) + ")"
