"""Word lists and small lexicons shipped with the package (plain text / CSV)."""

from __future__ import annotations

import csv
from functools import lru_cache
from pathlib import Path

HERE = Path(__file__).parent


@lru_cache(maxsize=None)
def words(name: str) -> tuple[str, ...]:
    """One word per line, in file order."""
    lines = (HERE / f"{name}.txt").read_text(encoding="utf-8").splitlines()
    return tuple(w for w in (x.strip() for x in lines) if w and not w.startswith("#"))


@lru_cache(maxsize=None)
def table(name: str) -> tuple[tuple[str, ...], ...]:
    """Rows of a small CSV (header skipped, ``#`` lines are comments)."""
    with open(HERE / f"{name}.csv", encoding="utf-8") as fh:
        rows = [r for r in csv.reader(fh) if r and not r[0].startswith("#")]
    return tuple(tuple(r) for r in rows[1:])
