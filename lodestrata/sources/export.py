"""Writing results: files, JSON, OpenMetrics text, charts, pages."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def write(df: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write a table as parquet, csv, json, orc or text (one column)."""
    writer = df.write.mode(mode)
    writer = writer.partitionBy(*by) if by else writer
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def printable(df: DataFrame) -> DataFrame:
    """``df`` with binary columns in hexadecimal, for CSV and JSON."""
    return df.select(*[F.hex(c).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes])


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text: ``json``."""
    return printable(df).select(F.to_json(F.struct("*")).alias("json"))


def table_stats(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """``entries, key_bytes, value_bytes, min_key, max_key``."""
    size = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    return df.agg(F.count("*").alias("entries"), size(key).alias("key_bytes"), size(value).alias("value_bytes"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def violations(log: DataFrame, max_key: int = 4096, max_value: int = 16 << 20) -> DataFrame:
    """``rule, rows`` of each rule that a commit log breaks."""
    op = F.lower(F.trim("op"))
    rules = {
        "null key": F.col("key").isNull(), "key too long": F.octet_length("key") > max_key, "value too long": F.octet_length("value") > max_value, "unknown op": ~F.coalesce(op.isin("put", "del", "delete"), F.lit(False)),
        "no transaction": F.col("txn_id").isNull() | F.col("seq").isNull(), "deleted with a value": op.isin("del", "delete") & F.col("value").isNotNull(),
    }
    row = log.agg(*[F.count_if(test).alias(f"r{i}") for i, test in enumerate(rules.values())])
    return row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("rows")) for i, name in enumerate(rules)])).alias("x")).select("x.rule", "x.rows").where(F.col("rows") > 0)


def openmetrics(kind: str, name: str, rows: DataFrame) -> DataFrame:
    """Lines of OpenMetrics text, ``line``, in the order of ``n``: counters and gauges from ``label, value``, histograms from ``le, count, sum, total``."""
    head = rows.sparkSession.range(1).select(F.lit(-1).cast("double").alias("n"), F.lit(f"# TYPE {name} {kind}").alias("line"))
    if kind != "histogram":
        body = rows.select(F.lit(0.0).alias("n"), F.format_string(f'{name}{{label="%s"}} %s', F.regexp_replace(F.col("label").cast("string"), r'(["\\])', r"\\$1"), F.col("value").cast("string")).alias("line"))
        return head.union(body)
    place = F.when(F.col("le") == "+Inf", 1e300).otherwise(F.col("le").cast("double"))
    buckets = rows.select(place.alias("n"), F.format_string(f'{name}_bucket{{le="%s"}} %d', "le", "count").alias("line"))
    tail = rows.where("le = '+Inf'").select(F.explode(F.array(F.struct(F.lit(1e301).alias("n"), F.format_string(f"{name}_sum %.6f", "sum").alias("line")), F.struct(F.lit(1e302).alias("n"), F.format_string(f"{name}_count %d", "total").alias("line")))).alias("x")).select("x.*")
    return head.union(buckets).union(tail)


def traces(spans: DataFrame) -> DataFrame:
    """``trace_id, json``: the spans of each trace, in order of start and id; a trace is bounded by what one request does."""
    columns = [c for c in spans.columns if c != "trace_id"]
    ordered = F.array_sort(F.collect_list(F.struct("start_ns", "span_id", *[c for c in columns if c not in ("start_ns", "span_id")])))
    return spans.groupBy("trace_id").agg(ordered.alias("spans")).select("trace_id", F.to_json(F.struct("trace_id", "spans")).alias("json"))


def chart(points: DataFrame, x: str, y: str, library: str, title: str = "", kind: str = "line", limit: int = 10_000) -> str:
    """The JSON of a chart of at most ``limit`` points, for chartjs, d3, vega, plotly or echarts."""
    rows = points.select(F.col(x).cast("string").alias("x"), F.col(y).cast("double").alias("y")).orderBy(x).limit(limit).collect()
    xs, ys = [r["x"] for r in rows], [r["y"] for r in rows]
    made = {
        "chartjs": lambda: {"type": kind, "data": {"labels": xs, "datasets": [{"label": title, "data": ys}]}},
        "d3": lambda: {"title": title, "kind": kind, "values": [{"x": a, "y": b} for a, b in zip(xs, ys)]},
        "vega": lambda: {"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "title": title, "mark": kind, "data": {"values": [{"x": a, "y": b} for a, b in zip(xs, ys)]}, "encoding": {"x": {"field": "x"}, "y": {"field": "y", "type": "quantitative"}}},
        "plotly": lambda: {"data": [{"x": xs, "y": ys, "type": "scatter" if kind == "line" else kind}], "layout": {"title": title}},
        "echarts": lambda: {"title": {"text": title}, "xAxis": {"data": xs}, "yAxis": {}, "series": [{"type": kind, "data": ys}]},
    }
    if library not in made:
        raise ValueError(f"unknown library {library}")
    return json.dumps(made[library]())


def dashboard(title: str, panels: Sequence[tuple[str, DataFrame]], kind: str = "html", limit: int = 1_000) -> str:
    """A page of tables, of at most ``limit`` rows each, as html, json or markdown."""
    tables = [(name, df.columns, [[None if v is None else str(v) for v in r] for r in df.limit(limit).collect()]) for name, df in panels]
    if kind == "json":
        return json.dumps({"title": title, "panels": [{"name": n, "columns": c, "rows": r} for n, c, r in tables]})
    if kind == "markdown":
        cell = lambda v: ("" if v is None else v).replace("|", "\\|").replace("\n", " ")
        parts = [f"## {n}\n\n| {' | '.join(c)} |\n|{'-|' * len(c)}\n" + "".join(f"| {' | '.join(map(cell, r))} |\n" for r in rows) for n, c, rows in tables]
        return f"# {title}\n\n" + "\n".join(parts)
    if kind != "html":
        raise ValueError(f"unknown format {kind}")
    e = lambda v: html.escape("" if v is None else v)
    parts = [f"<h2>{e(n)}</h2><table><tr>{''.join(f'<th>{e(x)}</th>' for x in c)}</tr>" + "".join("<tr>" + "".join(f"<td>{e(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>" for n, c, rows in tables]
    return f"<!doctype html><meta charset=utf-8><title>{e(title)}</title><h1>{e(title)}</h1>{''.join(parts)}"


def version_readable(reader: Column, writer: Column) -> Column:
    """Whether a reader of version ``major.minor.patch`` reads what a writer wrote: same major, and no newer minor."""
    part = lambda v, i: F.split_part(v, F.lit("."), F.lit(i)).try_cast("int")
    return (part(reader, 1) == part(writer, 1)) & (part(reader, 2) >= part(writer, 2))
