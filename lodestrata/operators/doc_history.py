"""Versions of documents: change logs, blame, churn and risk.

Versions have ``path, version_id, seq`` (their order), ``branch, author, ts, intent, severity, diffs`` (array of ``start_line, lines_removed,
lines_added``) and ``linked_issues``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestrata.operators.temporal import asof_join
from lodestrata.plans.lineage import cut
from lodestrata.plans.ranking import BIG_GROUP, null_safe_join, running_sums, value_blocks

# Weights of severities and intents.
SEVERITIES = ("trivial", "minor", "moderate", "major", "critical")
IMPACT = {"trivial": 0.1, "minor": 0.25, "moderate": 0.5, "major": 1.0, "critical": 2.0}
SEVERITY_RISK = {"trivial": 0.1, "minor": 0.25, "moderate": 0.5, "major": 0.75, "critical": 1.0}
INTENT_RISK = {"docs": 0.1, "style": 0.1, "tests": 0.2, "refactor": 0.5, "feature": 0.4, "perf": 0.6, "bugfix": 0.7, "security": 0.9, "other": 0.3}
PROPOSED_INTENT_RISK = {"docs": 0.05, "style": 0.05, "tests": 0.1, "refactor": 0.2, "feature": 0.15, "perf": 0.25, "bugfix": 0.3, "security": 0.4, "other": 0.1}


def weight(column: Column, weights: dict[str, float]) -> Column:
    """The weight of a name; null of an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), column)


def _lines(field: str) -> Column:
    return F.aggregate(F.coalesce(F.col("diffs"), F.array().cast("array<struct<start_line:int,lines_removed:int,lines_added:int>>")), F.lit(0).cast("long"), lambda s, d: s + F.coalesce(d[field], F.lit(0)))


def with_lines(versions: DataFrame) -> DataFrame:
    """``versions`` with ``added`` and ``removed`` lines."""
    return versions.withColumn("added", _lines("lines_added")).withColumn("removed", _lines("lines_removed"))


def matching(author: str | None = None, intent: str | None = None, severity: str | None = None, start: Column | None = None, end: Column | None = None, issue: str | None = None, branch: str | None = None) -> Column:
    """The filter of a change log; times are closed, what is None isn't asked."""
    tests = [
        None if author is None else F.col("author") == author,
        None if intent is None else F.col("intent") == intent,
        None if severity is None else F.col("severity") == severity,
        None if start is None else F.col("ts") >= start,
        None if end is None else F.col("ts") <= end,
        None if issue is None else F.array_contains("linked_issues", issue),
        None if branch is None else F.col("branch") == branch,
    ]
    out = F.lit(True)
    for test in tests:
        out = out if test is None else out & test
    return out


def changelog(versions: DataFrame, where: Column, path: str | None = None) -> DataFrame:
    """The matching versions, newest first, with their lines."""
    rows = versions if path is None else versions.where(F.col("path") == path)
    return with_lines(rows.where(where)).orderBy(F.desc("ts"), "path", F.desc("seq"))


def statistics(versions: DataFrame) -> DataFrame:
    """Over all: ``versions, added, removed, net, authors, impact, per_day`` (versions per day that has any)."""
    rows = with_lines(versions).agg(
        F.count("*").alias("versions"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.countDistinct("author").alias("authors"),
        F.sum(weight(F.col("severity"), IMPACT)).alias("impact"), F.countDistinct(F.to_date("ts")).alias("days"),
    )
    return rows.select("versions", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"), F.coalesce(F.col("added") - F.col("removed"), F.lit(0)).alias("net"), "authors", F.coalesce("impact", F.lit(0.0)).alias("impact"), F.try_divide("versions", "days").alias("per_day"))


def latest(versions: DataFrame) -> DataFrame:
    """The head of each path and branch."""
    return versions.groupBy("path", "branch").agg(F.max_by("version_id", "seq").alias("version_id"))


def versions_between(versions: DataFrame, path: str, first: str, last: str) -> DataFrame:
    """The versions of a path from one to another, both included."""
    own = versions.where(F.col("path") == path)
    ends = own.where(F.col("version_id").isin(first, last)).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    span = ends.select(F.struct("lo", "hi")).scalar()
    return own.where(F.col("seq").between(span["lo"], span["hi"]))


def hunks(versions: DataFrame) -> DataFrame:
    """Each version's diffs as rows: ``path, version_id, seq, hunk`` (from 0) ``, start_line, lines_removed, lines_added``."""
    return versions.select("path", "version_id", "seq", "author", F.posexplode("diffs").alias("hunk", "d")).select("path", "version_id", "seq", "author", "hunk", "d.*")


def blame(versions: DataFrame, line: int) -> DataFrame:
    """Who last touched a line of each path: the newest version with a hunk over it. Later shifts of lines don't count."""
    covers = hunks(versions).where((F.col("start_line") <= line) & (line < F.col("start_line") + F.col("lines_added")))
    return covers.groupBy("path").agg(F.max(F.struct("seq", "version_id", "author")).alias("x")).select("path", "x.version_id", "x.author")


def hot_files(versions: DataFrame) -> DataFrame:
    """``path, changes, frequency`` (per day of its span) ``, avg_severity, churn, risk`` of each path, for any ordering or limit."""
    rank = weight(F.col("severity"), {s: i + 1.0 for i, s in enumerate(SEVERITIES)})
    per = with_lines(versions).groupBy("path").agg(F.count("*").alias("changes"), F.min("ts").alias("a"), F.max("ts").alias("b"), (F.avg(rank) / 5).alias("avg_severity"), F.sum(F.col("added") + F.col("removed")).alias("lines"))
    days = F.greatest(F.lit(1), F.floor((F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 86_400_000_000))
    churn = F.least(F.lit(1.0), F.col("lines") / F.col("changes") / 1000)
    rows = per.select("path", "changes", (F.col("changes") / days).alias("frequency"), "avg_severity", churn.alias("churn"))
    risk = F.least(F.lit(1.0), F.col("frequency") / 10) * 0.4 + F.col("avg_severity") * 0.4 + F.least(F.lit(1.0), F.col("churn") * 10) * 0.2
    return rows.withColumn("risk", risk)


def churn(versions: DataFrame, high: float = 0.1, medium: float = 0.01) -> DataFrame:
    """``path, directory, changes, churn`` (lines per version in thousands) ``, level`` of each path."""
    per = with_lines(versions).groupBy("path").agg(F.count("*").alias("changes"), (F.sum(F.col("added") + F.col("removed")) / F.count("*") / 1000).alias("churn"))
    directory = F.when(F.contains(F.col("path"), F.lit("/")), F.regexp_extract("path", "^(.*)/", 1)).otherwise(".")
    return per.withColumn("directory", directory).withColumn("level", F.when(F.col("churn") > high, "high").when(F.col("churn") > medium, "medium").otherwise("low"))


def directory_churn(files: DataFrame) -> DataFrame:
    """``directory, changes, churn, risk``: the mean churn of a directory's paths, from :func:`churn`."""
    per = files.groupBy("directory").agg(F.sum("changes").alias("changes"), F.avg("churn").alias("churn"))
    return per.withColumn("risk", F.least(F.lit(1.0), F.col("churn") * 10))


def risk_level(score: Column) -> Column:
    return F.when(score < 0.3, "low").when(score < 0.6, "medium").when(score < 0.8, "high").otherwise("critical")


# The colour of each level.
COLORS = {"low": "green", "medium": "yellow", "high": "orange", "critical": "red"}


def risk_color(level: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in COLORS.items() for x in pair]), level)


def _neighbours_in_blocks(versioned: DataFrame, big: int) -> DataFrame:
    """``versioned`` (``path, _t``) with ``n``, the versions of its path, and ``near``, those of other times from an hour before on."""
    times = versioned.groupBy("path", "_t").agg(F.count("*").alias("same"))
    totals = times.groupBy("path").agg(F.sum("same").alias("n"))
    blocked, split = value_blocks(times, ["path"], "_t", big)
    upto = running_sums(blocked, ["path"], ["_t"], {"same": "upto"}, split)
    # All versions but those more than an hour older and those of the same time; the older ones are counted up to the last time before that hour.
    old = upto.select("path", F.col("_t").alias("ts"), F.lit(0).alias("seq"), "upto")
    hour = asof_join(times.select("path", (F.col("_t") - 3_600_000_001).alias("ts"), "_t", "same"), old, ["path"], big=big)
    near = null_safe_join(hour.select("path", "_t", "same", F.coalesce("match.upto", F.lit(0)).alias("far")), totals, ["path"])
    return null_safe_join(versioned, near.select("path", "_t", "n", (F.col("n") - F.col("far") - F.col("same")).alias("near")), ["path", "_t"])


def change_risk(versions: DataFrame, big: int = BIG_GROUP) -> DataFrame:
    """``path, version_id, score, level`` of each version; paths of more than ``big`` versions are counted in blocks of time.

    Severity weighs 0.3; 0.2, 0.25, 0.15 and 0.1 are added for paths of more than 10 versions, changes of more than 300 lines, risky intents,
    and more than 3 other versions since one hour before.
    """
    versioned = with_lines(versions).select("path", "version_id", "severity", "intent", (F.col("added") + F.col("removed")).alias("lines"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"))
    if versions.groupBy("path").count().where(F.col("count") > big).isEmpty():
        by_path = W.partitionBy("path")
        hour = by_path.orderBy("_t").rangeBetween(-3_600_000_000, W.unboundedFollowing)
        rows = versioned.withColumn("n", F.count("*").over(by_path)).withColumn("near", F.count("*").over(hour) - F.count("*").over(W.partitionBy("path", "_t")))
    else:
        rows = _neighbours_in_blocks(cut(versioned), big)
    capped = lambda c, over: F.least(F.lit(1.0), F.col(c) / F.lit(float(over)))
    often, large, intent, rapid = capped("n", 100), capped("lines", 1000), F.coalesce(weight(F.col("intent"), INTENT_RISK), F.lit(0.3)), capped("near", 10)
    score = (
        F.coalesce(weight(F.col("severity"), SEVERITY_RISK), F.lit(0.0)) * 0.3
        + F.when(often > 0.1, often * 0.2).otherwise(0.0)
        + F.when(large > 0.3, large * 0.25).otherwise(0.0)
        + F.when(intent > 0.5, intent * 0.15).otherwise(0.0)
        + F.when(F.col("near") > 3, rapid * 0.1).otherwise(0.0)
    )
    return rows.select("path", "version_id", score.alias("score")).withColumn("level", risk_level(F.col("score")))


def predicted_impact(versions: DataFrame, severity: str, intent: str) -> DataFrame:
    """``path, risk, confidence, regression_probability`` of a proposed change, for each path."""
    base = min(1.0, (SEVERITY_RISK[severity] + PROPOSED_INTENT_RISK[intent]) / 2)
    alike = F.count_if((F.col("severity") == severity) & (F.col("intent") == intent))
    serious = 1.0 if intent == "security" or severity == "critical" else 0.0
    per = versions.groupBy("path").agg(F.count("*").alias("n"), alike.alias("alike"))
    return per.select("path", risk_level(F.lit(base)).alias("risk"), F.least(F.lit(1.0), F.col("n") / 50).alias("confidence"), F.when(F.col("alike") > 0, serious).otherwise(0.0).alias("regression_probability"))
