"""Names of working columns that no input column has."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], stem: str) -> str:
    """``stem``, with underscores in front until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem
