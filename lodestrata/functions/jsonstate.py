"""Comparing JSON texts as values, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A number written with a zero fraction, and all that may stand between the end of one and the next: strings as wholes, other numbers, other
# characters. Each alternative begins with other characters and none gives anything back, so a text is read once.
_WHOLE = r"\d++\.0++(?=\s*+(?:[,}\]]|$))"
_WHOLE_FLOAT = rf'\G((?:[^"\d]++|"[^"\\]*+(?:\\.[^"\\]*+)*+"|(?!{_WHOLE})\d++(?:\.\d++)?+)*+)(\d++)\.0++(?=\s*+(?:[,}}\]]|$))'
#: Stands for a null state; longer than any digest.
NULL_STATE = bytes([255] * 17)


def canonical_json(text: Column) -> Column:
    """One spelling per JSON value: fields sorted at every depth, no blanks, one way of escaping.

    An integer and a float stay different (``1`` and ``1.0``), equal floats become equal (``2.50`` and ``2.5``). A text that
    is not JSON, or repeats a field within an object, stands for itself, and never equals a JSON value. Null stays null.
    """
    # A whole float becomes a double, which keeps its ".0"; a decimal would lose it and look like an integer.
    marked = F.when(text.rlike(r"\.0+\s*([,}\]]|$)"), F.regexp_replace(text, _WHOLE_FLOAT, "$1$2e0")).otherwise(text)
    parsed = F.to_json(F.try_parse_json(marked))
    return F.when(parsed.isNotNull(), F.concat(F.lit("j"), parsed)).otherwise(F.concat(F.lit("t"), text))


def state_hash(text: Column) -> Column:
    """128-bit hash of the JSON value as 16 bytes; a null state has one of its own (NULL_STATE)."""
    return F.coalesce(F.unhex(F.md5(canonical_json(text))), F.lit(NULL_STATE))
