"""Scanning texts: risky patterns, credentials, personal data, imports and calls, sizes and summaries."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The substrings that are looked for, and what they mean.
SQL_INJECTION = ("' OR '1'='1", "' OR 1=1--", "1'1", "admin'--", "'; DROP TABLE", "UNION SELECT", "1' ORDER BY", "' AND 1=1--", "'; EXEC xp_cmdshell")
XSS = ("<script>", "javascript:", "onerror=", "onload=", "onclick=", "<iframe", "eval(", "document.cookie", "fromCharCode", "<img src=x onerror")
PATH_TRAVERSAL = ("../", "..\\", "%2e%2e", "....//", "..%255c", "..%5c", "%252e%252e")
COMMANDS = ("; cat ", "| cat ", "`cat ", "$(cat ", "; ls ", "| ls ", "&& rm ", "; rm ", "nc -l", "bash -i")
SENSITIVE = ('"password"', '"api_key"', '"secret"', '"token"', '"private_key"', '"access_token"', '"auth_token"', '"credentials"', "sk-", "Bearer ", "Basic ", "AWS:", "AKIA")
CREDENTIALS = ("sk-", "AIza", "AKIA", "Bearer ")
MALICIOUS = ("eval(", "exec(", "system(", "__import__", "Runtime.exec")
SENSITIVITY = (("restricted", ("password", "api key", "secret")), ("confidential", ("confidential",)), ("internal", ("internal only",)))
IMPORTS = ("import ", "use ", "#include ", "from ", "package ")
INTENTS = (("security", ("vulnerability", "security", "xss", "injection")), ("perf", ("optimize", "performance", "cache")), ("tests", ("test",)), ("docs", ("//", "/*")), ("bugfix", ("fix", "bug")), ("feature", ("add", "implement")))
KEYWORDS = ("if", "else", "for", "while", "switch", "return", "fn", "func", "def", "class", "struct", "catch", "try", "and", "or", "not", "in")
SEVERITY_RANKS = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(n)) for n in needles])


def contains_any(text: Column, needles: tuple[str, ...], ignore_case: bool = False) -> Column:
    """Whether a text holds one of the substrings; null of a null text. Byte searches, which a regular expression of alternatives isn't."""
    return _any(F.lower(text), tuple(n.lower() for n in needles)) if ignore_case else _any(text, needles)


def findings(text: Column) -> Column:
    """The kinds of risk in a text: array of ``kind, severity, confidence``; empty for a clean and for a null text."""

    def kinds(x: Column) -> Column:
        low = lambda needles: _any(x["low"], tuple(n.lower() for n in needles))
        cases = [
            ("sql_injection", low(SQL_INJECTION), "high", 0.8),
            ("xss", low(XSS), "high", 0.8),
            ("path_traversal", _any(x["text"], PATH_TRAVERSAL), "medium", 0.7),
            ("command_injection", _any(x["text"], COMMANDS), "critical", 0.9),
            ("sensitive_data", low(SENSITIVE), "medium", 0.6),
        ]
        rows = [F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))) for kind, test, severity, confidence in cases]
        return F.filter(F.array(*rows), lambda r: r.isNotNull())

    # As a lambda's argument the lower-cased text is made once, not once for each substring.
    return F.get(F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"))), kinds), F.lit(0))


#: Kinds of risk with their substrings, and whether case matters.
DICTIONARY = (("sql_injection", SQL_INJECTION, False), ("xss", XSS, False), ("path_traversal", PATH_TRAVERSAL, True), ("command_injection", COMMANDS, True), ("sensitive_data", SENSITIVE, False))


def _automaton(needles: set[str]):
    """A search for all needles in one pass over a text, as (end, needle) pairs in order of ends."""
    try:
        import ahocorasick
    except ImportError:  # as slow as there are needles
        def search(text: str) -> list[tuple[int, str]]:
            return sorted((m.start() + len(n) - 1, n) for n in needles for m in re.finditer(f"(?={re.escape(n)})", text))

        return search
    machine = ahocorasick.Automaton()
    for n in needles:
        machine.add_word(n, n)
    machine.make_automaton()
    return machine.iter


def occurrences(texts: DataFrame, key: str, text: str, dictionary: Sequence[tuple[str, Sequence[str], bool]] = DICTIONARY) -> DataFrame:
    """``key, kind, needle, n, first``: how often a text holds each needle, without overlaps from the left, and where first (from 1).

    ``dictionary`` has kinds, their needles, and whether case matters; needles whose case doesn't come out in lower case and are looked for in the
    lower-cased text. One pass over a text finds all needles, however many; the dictionary goes to the tasks with the function and must
    fit them. Null texts hold nothing, empty needles are left out, rows keep their key even if it is null or repeated.
    """
    exact, folded = {}, {}
    for kind, needles, cased in dictionary:
        for n in filter(None, needles):
            into = exact if cased else folded
            kinds = into.setdefault(n if cased else n.lower(), [])
            if kind not in kinds:
                kinds.append(kind)
    out = T.StructType([T.StructField("key", texts.schema[key].dataType), T.StructField("kind", T.StringType()), T.StructField("needle", T.StringType()), T.StructField("n", T.LongType()), T.StructField("first", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [(kinds, _automaton(set(kinds)), fold) for kinds, fold in ((exact, False), (folded, True)) if kinds]
        for batch in batches:
            rows: list[tuple] = []
            for k, body in enumerate(batch.column(1).to_pylist()):
                for kinds, search, fold in searches if body else ():
                    seen: dict[str, list[int]] = {}
                    for end, n in search(body.lower() if fold else body):
                        begin = end - len(n) + 1
                        held = seen.setdefault(n, [0, begin, 0])
                        if begin >= held[2]:
                            held[0], held[2] = held[0] + 1, end + 1
                    rows += [(k, kind, n, count, first + 1) for n, (count, first, _) in seen.items() for kind in kinds[n]]
            at, *columns = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))]], ["key", "kind", "needle", "n", "first"])

    return texts.select(texts[key].alias("key"), texts[text].alias("text")).mapInArrow(run, out)


def severity_rank(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in SEVERITY_RANKS.items() for x in pair]), F.lower(name))


def has_credentials(text: Column) -> Column:
    return contains_any(text, CREDENTIALS)


def has_malicious_code(text: Column) -> Column:
    return contains_any(text, MALICIOUS)


def sensitivity(text: Column) -> Column:
    """The highest level whose words a text holds: restricted, confidential, internal, public; null of a null text."""
    out = F.when(text.isNotNull(), "public")
    for level, needles in reversed(SENSITIVITY):
        out = F.when(contains_any(F.lower(text), needles), level).otherwise(out)
    return out


#: Patterns of personal data and what stands in their place.
PERSONAL = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"), (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"), (r"\b(?:\d[ -]?){13,16}\b", "[CARD]"), (r"\+?\b\d{1,3}[ -]\d{3}[ -]\d{3,4}[ -]\d{3,4}\b", "[PHONE]"))


def redacted(text: Column) -> Column:
    """``text`` with personal data replaced, and their ``count``."""
    count, out = F.lit(0), text
    for pattern, name in PERSONAL:
        count = count + F.coalesce(F.regexp_count(out, F.lit(pattern)), F.lit(0))
        out = F.regexp_replace(out, pattern, name)
    return F.struct(out.alias("text"), count.alias("count"))


def sanitized(text: Column, max_chars: int) -> Column:
    """What may leave: redacted and cut text, and its sensitivity: ``text, redactions, level, safe``."""
    clean = redacted(text)
    return F.struct(F.substring(clean["text"], 1, max_chars).alias("text"), clean["count"].alias("redactions"), sensitivity(text).alias("level"), (~(has_credentials(text) | has_malicious_code(text))).alias("safe"))


def imports(code: Column) -> Column:
    """The paths named in import lines: between quotes or angle brackets, else the first word after the keyword."""
    lines = F.transform(F.split(code, "\n"), lambda s: F.regexp_replace(s, r"^[ \t\r]+|[ \t\r]+$", ""))
    found = F.filter(lines, lambda s: s.rlike("^(?:" + "|".join(map(re.escape, IMPORTS)) + ")"))
    path = lambda s: F.when(s.rlike(r"""["'<][^"'>]+["'>]"""), F.regexp_extract(s, r"""["'<]([^"'>]+)["'>]""", 1)).otherwise(F.regexp_extract(s, r"^\S+\s+([^\s;]+)", 1))
    return F.filter(F.transform(found, path), lambda p: p != "")


def calls(code: Column) -> Column:
    """The names before an opening parenthesis, of two characters at least, but for keywords."""
    names = F.regexp_extract_all(code, F.lit(r"([^ \t\n=()]{2,})\("), F.lit(1))
    return F.filter(names, lambda n: ~n.isin(list(KEYWORDS)))


def change_intent(text: Column) -> Column:
    """What a change is for, by the first kind whose words it holds."""
    out = F.lit("other")
    for intent, needles in reversed(INTENTS):
        out = F.when(contains_any(F.lower(text), needles), intent).otherwise(out)
    return out


def change_severity(lines: Column) -> Column:
    """How large a change is: 0, up to 2, 10, 50 lines, or more."""
    return F.when(lines == 0, "trivial").when(lines <= 2, "minor").when(lines <= 10, "moderate").when(lines <= 50, "major").otherwise("critical")


def issue_references(text: Column) -> Column:
    """Issues named as ``#123`` or ``ABC-123``, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(#\d+|\b[A-Z]{2,}-\d+)"), F.lit(1)))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / F.lit(4)).cast("long")


def summary_strategy(tokens: Column, target: int) -> Column:
    """How to shorten a text of so many tokens to a target: none, llm, sliding_window, hierarchical."""
    ratio = tokens / F.lit(float(target))
    return F.when(ratio <= 1, "none").when(ratio < 4, "llm").when(ratio >= 10, "hierarchical").otherwise("sliding_window")


def windowed_summary(text: Column, chars: int) -> Column:
    """The beginning, middle and end of a text that is longer than ``chars``, each a third."""
    third = chars // 3
    parts = [F.substring(text, 1, third), F.substr(text, F.floor((F.length(text) - third) / 2).cast("int") + 1, F.lit(third)), F.right(text, F.lit(third))]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws("\n...\n", *parts))
