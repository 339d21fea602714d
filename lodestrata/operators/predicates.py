"""Predicates: dimensions, scopes, globs and the small query language of topic searches."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F


def dimension(name: str, op: str, value: str, dims: str = "dims") -> Column:
    """A test of one dimension of a map column: equals, not_equals, contains, starts_with, ends_with. A missing one is null."""
    d = F.try_element_at(F.col(dims), F.lit(name))
    tests = {"equals": d == value, "not_equals": d != value, "contains": F.contains(d, F.lit(value)), "starts_with": F.startswith(d, F.lit(value)), "ends_with": F.endswith(d, F.lit(value))}
    return tests[op]


def compare(column: Column, op: str, value) -> Column:
    """The comparisons of record filters: eq, neq, gt, gte, lt, lte, contains."""
    tests = {"eq": lambda: column == value, "neq": lambda: column != value, "gt": lambda: column > value, "gte": lambda: column >= value, "lt": lambda: column < value, "lte": lambda: column <= value, "contains": lambda: F.contains(column, F.lit(value))}
    return tests[op]()


def glob(column: Column, pattern: str) -> Column:
    """Whether a text matches a glob as a whole: ``*`` any text, ``?`` one character."""
    regex = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", pattern))
    return column.rlike(rf"(?s)\A{regex}\z")


@dataclass
class TopicQuery:
    """A parsed topic search: terms and phrases with their operators, and filters."""

    required: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    filters: dict[str, str] = field(default_factory=dict)


FILTERS = ("type", "entity_type", "confidence", "after", "after_txn", "before", "before_txn", "time_range", "wildcard")


def parse_topic_query(text: str) -> TopicQuery:
    """Terms, quoted phrases, AND, OR, NOT and ``key:value`` filters; terms without operator are joined by AND.

    OR makes the terms on both its sides optional; NOT excludes the next one. A key that isn't a filter is part of a term.
    """
    tokens = [(m[1] if m[1] is not None else m[2], m[1] is not None) for m in re.finditer(r'"([^"]*)"|(\S+)', text)]
    query, groups, negated, joined = TopicQuery(), [], False, False
    for token, quoted in tokens:
        if not quoted and token in ("AND", "OR", "NOT"):
            negated, joined = negated or token == "NOT", joined or token == "OR"
            continue
        key, colon, value = token.partition(":")
        if not quoted and colon and key in FILTERS and value:
            query.filters[key] = value
            continue
        term = token.lower()
        if not term:
            continue
        if negated:
            query.excluded.append(term)
        elif joined and groups:
            groups[-1].append(term)
        else:
            groups.append([term])
        negated = joined = False
    query.required = [g[0] for g in groups if len(g) == 1]
    query.optional = [t for g in groups if len(g) > 1 for t in g]
    return query


def scope(filters: dict[str, str], entity_type: str = "type", confidence: str = "confidence", created: str = "created_at", ts: str = "ts", name: str = "id") -> Column:
    """The filters of a topic query as one predicate over entities."""
    out = F.lit(True)
    for key, value in filters.items():
        if key in ("type", "entity_type"):
            out &= F.col(entity_type) == value
        elif key == "confidence":
            out &= F.col(confidence) >= float(value)
        elif key in ("after", "after_txn"):
            out &= F.col(created) >= int(value)
        elif key in ("before", "before_txn"):
            out &= F.col(created) <= int(value)
        elif key == "time_range":
            low, high = value.split(",")
            out &= F.col(ts).between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))
        elif key == "wildcard":
            out &= glob(F.col(name), value)
    return out
