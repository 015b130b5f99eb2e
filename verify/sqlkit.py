"""Named SQL parts for the DuckDB side: each oracle pulls in the parts it mentions."""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def _needs(sql: str) -> list[str]:
    return [n for n in PARTS if re.search(rf"(?:FROM|JOIN)\s+{n}\b", sql)]


def oracle(sql: str) -> str:
    """The statement with a WITH clause that defines every part it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in _needs(PARTS[name]):
            if n != name:
                visit(n)
        order.append(name)

    for n in _needs(sql):
        visit(n)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in order) + "\n" + sql
