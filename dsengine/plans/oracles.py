"""Helpers to write the DuckDB oracle SQL for long-format per-column results.

These generate plain SQL text (UNION ALL of one SELECT per column); they are
not a planner - the oracle runs in DuckDB only for the correctness gate.
"""

from __future__ import annotations


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def per_column(cols: list[str], template: str) -> str:
    """UNION ALL of ``template`` formatted with {c} (quoted name), {name}
    (text literal) and {i} (ordinal)."""
    parts = [template.format(c=q(c), name="'" + c.replace("'", "''") + "'", i=i)
             for i, c in enumerate(cols)]
    return "\nUNION ALL\n".join(parts)
