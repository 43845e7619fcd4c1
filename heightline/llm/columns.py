"""Column names of inputs that may clash with those an operator makes. Spark tells no case apart."""

from __future__ import annotations

from collections.abc import Iterable


def others(columns: Iterable[str], *names: str) -> list[str]:
    """The columns that none of names would overwrite."""
    made = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in made]


def spare(columns: Iterable[str], name: str) -> str:
    """name, with as many more underscores before it as no column of the input has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
