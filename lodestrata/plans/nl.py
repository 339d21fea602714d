"""Questions in plain words, read by a grammar and answered by DataFrame plans.

    question  = measure ["of" FIELD] "in" SOURCE {clause}
    measure   = "count" | "list" | "distinct" | "total" | "average" | "least" | "greatest"
    clause    = "where" condition {"and" condition} | "since" TIME | "before" TIME | "per" (FIELD | period) | "top" NUMBER
    condition = FIELD ("is not" | "is" | "over" | "under" | "at least" | "at most" | "contains") VALUE
    period    = "minute" | "hour" | "day" | "week" | "month"

Words are read without regard to case; names, times and values with blanks stand in quotes. ``count`` and ``list`` need no field. Each clause stands
once at most, in any order. What the grammar doesn't know is an error that names the word, never a guess.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

_TOKEN = re.compile(r"""\s*(?:'([^']*)'|"([^"]*)"|([^\s'"]+))""")
_PERIODS = {"minute", "hour", "day", "week", "month"}
_MEASURES = {"count": None, "list": None, "distinct": F.countDistinct, "total": F.sum, "average": F.avg, "least": F.min, "greatest": F.max}
_TESTS = {
    "is not": lambda c, v: ~c.eqNullSafe(v),
    "is": lambda c, v: c == v,
    "over": lambda c, v: c > v,
    "under": lambda c, v: c < v,
    "at least": lambda c, v: c >= v,
    "at most": lambda c, v: c <= v,
    "contains": lambda c, v: F.contains(F.lower(c.cast("string")), F.lower(v)),
}


class Unclear(ValueError):
    """A question that the grammar doesn't cover."""


@dataclasses.dataclass
class Question:
    """The filled slots of a question."""

    measure: str
    source: str
    field: str | None = None
    conditions: list[tuple[str, str, str]] = dataclasses.field(default_factory=list)
    since: str | None = None
    before: str | None = None
    per: str | None = None
    top: int | None = None


class _Words:
    def __init__(self, text: str) -> None:
        self.words: list[tuple[str, bool]] = []
        at, text = 0, text.strip().removesuffix("?").rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise Unclear(f"an open quote in {text[at:]!r}")
            self.words.append((next(x for x in m.groups() if x is not None), m[3] is None))
            at = m.end()

    def take(self, what: str) -> str:
        if not self.words:
            raise Unclear(f"{what} is missing at the end")
        return self.words.pop(0)[0]

    def accept(self, *phrases: str) -> str | None:
        """The first of the phrases that comes next, unquoted, if any does."""
        for phrase in phrases:
            parts = phrase.split()
            if [w.lower() for w, quoted in self.words[: len(parts)] if not quoted] == parts:
                del self.words[: len(parts)]
                return phrase
        return None

    def demand(self, what: str, *phrases: str) -> str:
        found = self.accept(*phrases)
        if found is None:
            raise Unclear(f"{what} expected, not {self.words[0][0] if self.words else 'the end'!r}")
        return found


def read(text: str) -> Question:
    """The question that a text asks."""
    words = _Words(text)
    measure = words.demand("a measure", *_MEASURES)
    name = words.take("a field") if words.accept("of") else None
    if _MEASURES[measure] is not None and name is None:
        raise Unclear(f"{measure} of which field?")
    words.demand("in", "in")
    q = Question(measure, words.take("a source").lower(), name)
    seen: set[str] = set()
    while words.words:
        clause = words.demand("where, since, before, per or top", "where", "since", "before", "per", "top")
        if clause in seen:
            raise Unclear(f"{clause} stands twice")
        seen.add(clause)
        if clause == "where":
            q.conditions.append((words.take("a field"), words.demand("a comparison", *_TESTS), words.take("a value")))
            while words.accept("and"):
                q.conditions.append((words.take("a field"), words.demand("a comparison", *_TESTS), words.take("a value")))
        elif clause == "top":
            if not (n := words.take("a number")).isdigit():
                raise Unclear(f"a number expected, not {n!r}")
            q.top = int(n)
        else:
            setattr(q, clause, words.take("a name" if clause == "per" else "a time"))
    return q


def _column(df: DataFrame, name: str) -> Column:
    for c in df.columns:
        if c.lower() == name.lower():
            return df[c]
    raise Unclear(f"no field {name!r}")


def _test(df: DataFrame, name: str, test: str, value: str) -> Column:
    """Values compare as what the field is; one that can't be read as that is an error of the question, found before any job."""
    c = _column(df, name)
    if test == "contains":
        return _TESTS[test](c, F.lit(value))
    kind = df.select(c).schema[0].dataType
    if kind.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        try:
            return _TESTS[test](c, F.lit(float(value) if "." in value or "e" in value.lower() else int(value)))
        except ValueError:
            raise Unclear(f"{name} is a number, {value!r} isn't") from None
    return _TESTS[test](c, F.lit(value).cast(kind))


def answer(text: str, sources: Mapping[str, DataFrame], time: str = "ts") -> DataFrame:
    """The answer: ``answer``, led by ``per`` where the question groups; the rows themselves, if it lists.

    Filters come before the grouping and reach the scan. ``top`` keeps the greatest answers, ties by ``per``; of a list the latest rows.
    """
    q = read(text)
    if q.source not in sources:
        raise Unclear(f"no source {q.source!r}")
    df = sources[q.source]
    for condition in q.conditions:
        df = df.where(_test(df, *condition))
    kind = df.schema[time].dataType if time in df.columns else None
    for bound, test in ((q.since, "at least"), (q.before, "under")):
        if bound is not None:
            df = df.where(_TESTS[test](_column(df, time), F.lit(bound).cast(kind)))
    if q.measure == "list":
        rows = df if q.field is None else df.select(_column(df, q.field))
        return rows if q.top is None else df.orderBy(_column(df, time).desc()).select(*rows.columns).limit(q.top)
    by = [] if q.per is None else [(F.date_trunc(q.per, _column(df, time)) if q.per.lower() in _PERIODS else _column(df, q.per)).alias("per")]
    measured = F.count("*" if q.field is None else _column(df, q.field)) if q.measure == "count" else _MEASURES[q.measure](_column(df, q.field))
    out = df.groupBy(*by).agg(measured.alias("answer"))
    return out if q.top is None else out.orderBy(F.desc("answer"), *(["per"] if by else [])).limit(q.top)
