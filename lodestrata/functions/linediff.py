"""Line differences of two texts."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

_HUNKS = "array<struct<start_line:int,lines_removed:int,lines_added:int,removed:string,added:string>>"


def hunks_of(old: str | None, new: str | None) -> list[dict]:
    """The hunks that turn ``old`` into ``new``: the line of ``old`` (from 0) where each begins, and its lines; null is an empty text."""
    a, b = (old or "").splitlines(), (new or "").splitlines()
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op != "equal":
            out.append({"start_line": i, "lines_removed": j - i, "lines_added": m - k, "removed": "\n".join(a[i:j]), "added": "\n".join(b[k:m])})
    return out


def patched(old: str | None, hunks: list[dict]) -> list[str]:
    """The lines of ``old`` after its hunks."""
    lines = (old or "").splitlines()
    for h in reversed(hunks):
        lines[h["start_line"] : h["start_line"] + h["lines_removed"]] = h["added"].split("\n") if h["lines_added"] else []
    return lines


def line_diff(old: Column, new: Column) -> Column:
    """:func:`hunks_of` of two columns, in Arrow batches."""

    @pandas_udf(_HUNKS)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([hunks_of(x, y) for x, y in zip(a, b)])

    return run(old, new)


def restores(old: Column, hunks: Column, new: Column) -> Column:
    """Whether the hunks turn the lines of ``old`` into those of ``new``."""

    @pandas_udf("boolean")
    def run(a: pd.Series, h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([patched(x, list(y)) == (z or "").splitlines() for x, y, z in zip(a, h, b)])

    return run(old, hunks, new)
