"""Small cases of the other operators: ties, nulls, guards, and pure functions."""

import json
import random
import sys
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import ids, textscan
from lodestrata.functions.linediff import hunks_of, patched
from lodestrata.functions.registry import Extensions
from lodestrata.operators import anomaly, derived, doc_history, graph, predicates, ranking, search, series, temporal, timetravel, usage, vector
from lodestrata.plans import nl
from lodestrata.plans.ranking import lagged, running_sums, value_blocks
from lodestrata.sources import export
from lodestrata.sources.commit_log import CommitConflict, CommitLog, WriteBusy
from lodestrata.streaming import run, stateful, windows

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def when(seconds):
    return F.lit(at(seconds)).cast("timestamp_ntz")


CHANGES = "seq long, ts timestamp_ntz, entity_ns string, entity_id string, key string, old_value string, new_value string"


def changes(spark, rows):
    return spark.createDataFrame([(i, at(t), "n", e, k, None, v) for i, (t, e, k, v) in enumerate(rows, 1)], CHANGES)


def test_as_of(spark):
    df = changes(spark, [(0, "a", "s", "1"), (0, "a", "s", "2"), (10, "a", "s", None), (5, "b", "s", "x")])
    value = lambda t: {r.entity_id: (r.seq, r.new_value) for r in temporal.as_of(df, when(t)).collect()}
    assert value(-1) == {} and value(0) == {"a": (1, "1")} and value(99) == {"a": (3, None), "b": (4, "x")}
    asked = spark.createDataFrame([("n", "a"), ("n", "zz"), ("n", "a")], "entity_ns string, entity_id string")
    assert sorted((r.entity_id, r.seq or 0) for r in temporal.multi_as_of(df, asked, when(0)).collect()) == [("a", 1), ("a", 1), ("zz", 0)]
    assert {r.entity_id: r.seq for r in temporal.first_state(df).collect()} == {"a": 1, "b": 4}
    assert {r.entity_id: r.seq for r in temporal.last_state(df).collect()} == {"a": 3, "b": 4}
    assert temporal.numeric(changes(spark, [(0, "a", "k", "abc"), (1, "a", "k", None), (2, "a", "k", "1.5"), (3, "a", "k", "NaN")])).count() == 1


def test_field_delta(spark):
    df = spark.createDataFrame([('{"a":1,"b":2,"x":{"p":1,"q":2}}', '{"a":1,"b":3,"c":4,"x":{"q":2, "p":1}}'), ('{"a":1}', '{"a":1.0}'), (None, '{"a":1}'), ("[1]", "no")], "o string, n string")
    got = [[(d.field, d.change) for d in r[0]] for r in df.select(temporal.field_delta(F.col("o"), F.col("n"))).collect()]
    assert got == [[("b", "modified"), ("c", "added")], [("a", "modified")], [("a", "added")], []]


def points(spark, values, step=60):
    return spark.createDataFrame([("s", i, at(i * step), float(v)) for i, v in enumerate(values)], "g string, event_id long, ts timestamp_ntz, value double")


def test_series(spark):
    assert spark.range(1).select(series.bucket_key(F.lit(1640995200000), "1h")).first()[0] == 455832
    p = points(spark, range(1, 11))
    r = series.floor_percentiles(p, ["g"], {"p50": 50, "p95": 95, "p99": 99}).first()
    assert (r.p50, r.p95, r.p99) == (5, 9, 9)
    r = series.bucket_aggregate(p, "1d", ["p50", "p95"], ["g"]).first()
    assert r.p50 == 5.5 and r.p95 == pytest.approx(9.55)
    assert series.bucket_aggregate(points(spark, [-5, -3]), "1d", ["max"], ["g"]).first()["max"] == -3
    with pytest.raises(ValueError):
        series.downsample(p, "1h", "1m")
    assert [r["count"] for r in series.dense_histogram(points(spark, [1, 1, 1], 7200), 3600, ["g"]).orderBy("bucket").collect()] == [1, 0, 1, 0, 1]
    assert series.value_histogram(points(spark, [3, 3, 3])).where("count > 0").count() == 1
    assert series.activity_heatmap(p.limit(0)).count() == 168
    days = [0, 7, 30, 90, 365, 730]
    levels = spark.createDataFrame([(d * 86400,) for d in days], "a long").select(series.retention_level(F.col("a"))).collect()
    assert [r[0] for r in levels] == ["raw", "1m", "5m", "1h", "1d", "1w"]


def test_outlier_guards(spark):
    assert anomaly.zscore_outliers(points(spark, [1, 100]), ["g"], 0.1).count() == 0
    assert anomaly.zscore_outliers(points(spark, [5, 5, 5, 5]), ["g"], 0.1).count() == 0
    assert [r.value for r in anomaly.zscore_outliers(points(spark, [1, 1, 1, 1, 1, 1, 50]), ["g"], 2.0).collect()] == [50]
    assert anomaly.iqr_outliers(points(spark, [1, 2, 3]), ["g"]).count() == 0 and anomaly.iqr_outliers(points(spark, [4] * 8), ["g"]).count() == 0
    b = anomaly.baseline(points(spark, [10, 20, 30, 40, 50]), ["g"]).first()
    assert (b.mean, b.median, b.n) == (30, 30, 5)
    t = anomaly.trend(points(spark, [10, 20, 30, 40, 50]), ["g"], ["ts", "event_id"]).first()
    assert t.trend_type == "increasing" and t.strength > 0.9
    assert [r.predicted for r in anomaly.forecast(points(spark, [10, 20, 30]), ["g"], ["ts", "event_id"], 2).orderBy("step").collect()] == pytest.approx([40, 50])


@pytest.mark.parametrize("block", [7, 4096])
def test_ema(spark, monkeypatch, block):
    monkeypatch.setattr(anomaly, "RUN", block)
    rng = random.Random(4)
    values = [rng.gauss(10, 1) + (40 if i in (33, 70) else 0) for i in range(90)]
    ema = values[0]
    for v in values[:10]:
        ema = 0.2 * v + 0.8 * ema
    var = 0.0
    for v in values:
        ema = 0.2 * v + 0.8 * ema
        var = 0.2 * (v - ema) ** 2 + 0.8 * var
    ema, want = values[0], {}
    for i, v in enumerate(values):
        ema = 0.2 * v + 0.8 * ema
        if abs(v - ema) > 2.5 * var**0.5:
            want[i] = ema
    got = {r.event_id: r.ema for r in anomaly.ema_anomalies(points(spark, values), ["g"], ["ts", "event_id"]).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    assert anomaly.ema_anomalies(points(spark, values[:9]), ["g"], ["ts", "event_id"]).count() == 0


def test_commit_log(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0 and log.get(b"k") is None
    state, versions, rng = {}, {0: {}}, random.Random(2)
    for _ in range(4):
        txn = log.begin()
        with pytest.raises(WriteBusy):
            log.begin()
        for _ in range(5):
            key = rng.choice([b"a", b"a\xff", b"a\xff\xff", b"b", b"\xff"])
            if rng.random() < 0.3:
                txn.delete(key)
                state.pop(key, None)
            else:
                value = rng.choice([b"", None, b"v%d" % rng.randrange(9)])
                txn.put(key, value)
                state[key] = value
            assert txn.get(key) == state.get(key)
        versions[txn.commit()] = dict(state)
    txn = log.begin()
    txn.put(b"gone", b"1")
    txn.abort()
    plain = lambda df: {bytes(r.key): None if r.value is None else bytes(r.value) for r in df.collect()}
    for n, want in versions.items():
        assert plain(log.read(n)) == want
    with pytest.raises(timetravel.SnapshotNotFound):
        log.read(99)
    assert plain(timetravel.key_prefix(log.read(), b"a\xff")) == {k: v for k, v in state.items() if k.startswith(b"a\xff")}
    assert timetravel.prefix_end(b"a\xff") == b"b" and timetravel.prefix_end(b"\xff") is None
    short = log.truncate(2, str(tmp_path / "short"))
    assert plain(short.read()) == state and plain(short.read(3)) == versions[3]
    assert timetravel.states_equal(log.frame(), 2, 2) and timetravel.checksum(log.frame()).count() == 4


def test_predicates(spark):
    q = predicates.parse_topic_query('"database performance" AND btree NOT slow type:file confidence:0.8 after:100 wildcard:src/*')
    assert q.required == ["database performance", "btree"] and q.excluded == ["slow"] and q.filters == {"type": "file", "confidence": "0.8", "after": "100", "wildcard": "src/*"}
    q = predicates.parse_topic_query("a OR b c")
    assert q.optional == ["a", "b"] and q.required == ["c"]
    cases = [("abc", "abc", True), ("xbc", "abc", False), ("src/a/b", "src/*", True), ("a.txt", "*.txt", True), ("ab", "a?", True), ("a", "a?", False), ("a\nb", "a*b", True), ("a+b", "a+b", True), ("", "*", True)]
    for text, pattern, want in cases:
        assert spark.createDataFrame([(text,)], "t string").select(predicates.glob(F.col("t"), pattern)).first()[0] is want, (text, pattern)


def test_topics(spark):
    docs = spark.createDataFrame([("f", "a_tree.txt", "oak database btree"), ("f", "pages.txt", "Oak pager io oak"), ("f", "none", None)], "ns string, id string, text string")
    index = search.postings(docs, "text")
    names = lambda df: sorted(r.id for r in df.collect())
    assert names(search.search_any(index, ["oak"])) == ["a_tree.txt", "pages.txt"] and names(search.search_all(index, ["oak", "btree"])) == ["a_tree.txt"]
    assert names(search.search(index, predicates.parse_topic_query("oak NOT btree"))) == ["pages.txt"]
    assert search.term_stats(index, 3).where("term = 'oak'").first().tf == 3


def test_questions(spark):
    rows = [(i, at(86400 * i), "ab"[i % 2], "x y" if i == 3 else None, float(i)) for i in range(10)]
    sources = {"events": spark.createDataFrame(rows, "id int, ts timestamp_ntz, kind string, `note` string, value double")}
    ask = lambda text: [tuple(r) for r in nl.answer(text, sources).collect()]
    assert ask("count in events") == [(10,)] and ask("COUNT of note in Events?") == [(1,)]
    assert sorted(ask("total of value in events where kind is a per KIND")) == [("a", 20.0)]
    assert ask("greatest of value in events where value under 4.5 and id is not 4 before 2024-01-03") == [(1.0,)]
    assert ask("list of id in events where note contains 'X Y'") == [(3,)] and ask("list of id in events since '2024-01-08 00:00:00' top 2") == [(9,), (8,)]
    assert ask("count in events where id at least 2 and id at most 3 per week top 1") == [(at(0), 2)]
    assert nl.read("average of 'in' in \"where\" top 3") == nl.Question("average", "where", "in", top=3)
    for text in ("", "sum of x in events", "average in events", "count events", "count in nothing", "count in events where id is", "count in events per kind per kind", "count in events where id near 3", "count in events where id is many", "count in events top few", "count in events per size", "count in 'events"):
        with pytest.raises(nl.Unclear):
            nl.answer(text, sources)


def test_ema_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(300)] + [0.0] * 30
    for keep in (0.8, 0.999, 1e-40, 0.0):
        want, s = [], 0.0
        for v in values:
            s = v + keep * s
            want.append(s)
        for run_ in (7, 4096):
            monkeypatch.setattr(anomaly, "RUN", run_)
            df = spark.createDataFrame([(g, i + 1, v) for g in ("s", None) for i, v in enumerate(values)], "g string, i long, x double")
            for r in anomaly.decayed_sums(df, ["g"], "i", "x", keep, "s", len(values)).collect():
                assert r.s == pytest.approx(want[r.i - 1], rel=1e-9, abs=1e-12)
    assert anomaly.ema_anomalies(points(spark, values).limit(0), ["g"], ["ts"]).collect() == []


def test_long_series_in_many_tasks(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("'s' AS g", "id AS event_id", "timestamp_seconds(id) AS ts", "CAST(pmod(id * 7919, 1000) AS DOUBLE) + IF(id = 700000, 1e6, 0) AS value")
    numbered = series.numbered(df, ["g"], ["ts", "event_id"])
    assert numbered.where("i != event_id + 1").isEmpty()
    found = anomaly.ema_anomalies(df, ["g"], ["ts", "event_id"], sigma=1000.0)
    ema, last = 0.0, None
    for k in range(n):
        v = float(k * 7919 % 1000) + (1e6 if k == 700000 else 0)
        ema = v if k == 0 else 0.2 * v + 0.8 * ema
        last = ema if k == 700000 else last
    assert [(r.event_id, r.ema) for r in found.collect()] == [(700000, pytest.approx(last))]
    places = series.ranked_places(df, [], {"median": F.floor(F.col("n") / 2)}).first()
    assert (places.n, places.median) == (n, 500.0)


@pytest.mark.parametrize("big", [3, 10**6])
def test_asof_join_in_blocks(spark, big):
    rng = random.Random(big)
    theirs = [(rng.choice(["a", "a", "b", None]), rng.choice([None, rng.randrange(40)]), k) for k in range(60)]
    ours = [(rng.choice(["a", "a", "b", "c", None]), rng.choice([None, rng.randrange(45)]), k) for k in range(60)]
    frame = lambda rows: spark.createDataFrame([(g, None if t is None else at(t), k) for g, t, k in rows], "g string, ts timestamp_ntz, seq long")
    got = {r.seq: r.match and r.match.seq for r in temporal.asof_join(frame(ours), frame(theirs), ["g"], big=big).collect()}
    for g, t, k in ours:
        fit = [(x, -s, s) for h, x, s in theirs if h == g and x is not None and t is not None and x <= t]
        assert got[k] == (max(fit)[2] if fit else None), (g, t, k)


@pytest.mark.parametrize("big", [4, 10**6])
def test_neighbours_in_blocks(spark, big):
    rng = random.Random(big)
    rows = [(i, rng.choice(["a", "a", None]), at(rng.randrange(60)), rng.choice([None, float(i)])) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, g string, ts timestamp_ntz, value double")
    chains = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        chains.setdefault(r[1], []).append(r)
    want = {r[0]: (n + 1, chain[n - 1][0] if n else None, (lambda v: sum(v) / len(v) if v else None)([x[3] for x in chain[: n + 1] if x[3] is not None])) for chain in chains.values() for n, r in enumerate(chain)}
    chained = {r.id: (r.chain_version, r.chain_parent) for r in temporal.numbered_snapshots(df, ["g"], ["ts", "id"], "id", big).collect()}
    assert chained == {i: w[:2] for i, w in want.items()}
    assert {r.id: r.running for r in usage.running_average(df, ["g"], ["ts", "id"], "value", big).collect()} == {i: w[2] and pytest.approx(w[2]) for i, w in want.items()}
    log = changes(spark, [(t * 7 % 50, rng.choice("ab"), "k", str(rng.randrange(9))) for t in range(50)])
    both = [sorted(tuple(r) for r in temporal.rates(log, when(0), when(99), 60, b).collect()) for b in (big, 10**9)]
    assert [x[:4] + (round(x[4], 9),) for x in both[0]] == [x[:4] + (round(x[4], 9),) for x in both[1]] and len(both[0]) == 2


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_indexed_neighbours(spark, monkeypatch, metric):
    monkeypatch.setattr(vector, "CELL_ROWS", 40)
    rng = np.random.default_rng(3)
    hubs = rng.normal(size=(12, 16)) * 5
    x = hubs[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16))
    x[:300] = hubs[0] + rng.normal(size=(300, 16)) * 0.5  # one cell holds a third
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [1.0, 2.0]), (1002, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 10 = 0")
    centres = vector.fit_cells(df, 24, metric)
    probes, recall = vector.probes_for(df, asked, centres, 5, 0.95, metric)
    assert recall >= 0.95 and probes <= 12  # structure lets few cells suffice
    exact = {(r.query_id, r.neighbor_id): r.distance for r in vector.nearest_each(df, asked, 5, metric).collect()}
    found = {(r.query_id, r.neighbor_id): r.distance for r in vector.nearest_indexed(df, asked, 5, metric, cells=24).collect()}
    same = exact.keys() & found.keys()
    assert len(same) >= 0.9 * len(exact) and all(found[p] == pytest.approx(exact[p]) for p in same)
    assert vector.nearest_indexed(df.limit(0), asked, 5, metric).collect() == [] and vector.nearest_indexed(df, asked.limit(0), 5, metric).collect() == []
    with pytest.raises(ValueError):
        vector.nearest_indexed(df, asked, 5, "dot")


def test_one_group_of_all(spark):
    df = points(spark, range(100))
    for big in (10, 1000):
        blocked, split = value_blocks(df.withColumn("_one", F.lit(1)), [], "value", big, 8)
        assert split == (big == 10) and blocked.select("block").distinct().count() == (8 if split else 1)
        assert [r.i for r in running_sums(blocked, [], ["value"], {"_one": "i"}, split).orderBy("value").collect()] == list(range(1, 101))
        assert [r.was for r in lagged(df, [], ["ts"], {"event_id": "was"}, big).orderBy("value").collect()] == [None, *range(99)]
    assert anomaly.ema_anomalies(df, [], ["ts", "event_id"]).columns == [*df.columns, "ema", "deviation"]
    hot = spark.createDataFrame([(None, float(i)) for i in range(50)], "g string, value double")  # a null group is split too
    assert value_blocks(hot, ["g"], "value", 10, 8)[0].select("block").distinct().count() == 8


def test_places_and_rollups_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None]), at(rng.randrange(7200)), rng.choice([None, float(rng.randrange(50)), rng.random()])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, value double")
    both = []
    for big in (5, 10**6):
        monkeypatch.setattr(series, "BIG_GROUP", big)
        monkeypatch.setattr(series.value_blocks, "__defaults__", (big, 16))
        places = {(r.g, r.n, r.a, r.b) for r in series.ranked_places(df, ["g"], {"a": F.floor(F.col("n") / 3), "b": F.col("n") - 1}).collect()}
        for g, n, a, b in places:
            values = sorted(v for h, _, v in rows if h == g and v is not None)
            assert (n, a, b) == (len(values), values[n // 3], values[-1])
        both.append(sorted((str(r.g), r.window_start, r["count"], round(r.p95, 9), round(r.p99, 9)) for r in series.build_rollups(df, 3600, ["g"]).collect()))
    assert both[0] == both[1] and len(both[0]) == 4


def test_graph(spark):
    e = lambda *rows: spark.createDataFrame([(a, b, t, s, i) for i, (a, b, t, s) in enumerate(rows)], "src string, dst string, rel_type string, strength double, seq long")
    nodes = lambda *xs: spark.createDataFrame([(x,) for x in xs], "node string")
    pairs = lambda *xs: spark.createDataFrame(list(xs), "src string, dst string")
    edges = e(("a", "b", "imports", 0.8), ("b", "c", "imports", 0.8), ("a", "d", "calls", 0.9))
    r = graph.shortest_paths(edges, pairs(("a", "c"), ("c", "a"), ("a", "a"))).collect()
    assert {(x.src, x.dst): (x.hops, x.path, pytest.approx(x.strength)) for x in r} == {("a", "c"): (2, ["a", "b", "c"], 0.64), ("a", "a"): (0, ["a"], 1.0)}
    assert {x.node for x in graph.neighbors(edges, nodes("a"), 1).collect()} == {"b", "d"} and {x.node for x in graph.neighbors(edges, nodes("a"), 2, ["imports"]).collect()} == {"b", "c"}
    cycle = e(("a", "b", "x", 1.0), ("b", "a", "x", 1.0))
    assert sorted(x.path for x in graph.walks(cycle, nodes("a"), 3).collect()) == [["a", "b"], ["a", "b", "a"], ["a", "b", "a", "b"]]
    assert graph.simple_paths(e(("a", "b", "x", 0.8), ("a", "b", "y", 0.9)), pairs(("a", "b")), 3).count() == 2
    assert {(x.node, x.direction) for x in graph.lineage(edges, "b", 3).collect()} == {("c", "descendant"), ("a", "ancestor")}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 0.0, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vector.nearest(df, [1, 0, 0], 2, "cosine").collect()] == [1, 2]
    assert vector.nearest(df, [1, 0, 0], 9, "cosine").where("vec_id = 4").first().distance == 1.0
    for metric in vector.DISTANCES:
        got = {(r.query_id, r["rank"]): r.neighbor_id for r in vector.nearest_each(df, df.where("vec_id = 1"), 2, metric).collect()}
        assert got == {(1, i + 1): r.vec_id for i, r in enumerate(vector.nearest(df.where("vec_id != 1"), [1, 0, 0], 2, metric).collect())}
    assert vector.nearest_each(df, df.limit(0), 2).collect() == []
    gone = spark.createDataFrame([(1, [0.5, 0.0, 0.0], False), (2, None, True)], "vec_id long, embedding array<float>, deleted boolean")
    assert {r.vec_id for r in vector.upsert(df, gone).collect()} == {1, 3, 4, 5}


def test_documents(spark):
    rows = [("p", "v1", 1, "main", "alice", at(1000), "feature", "major", [(0, 5, 10)], ["I-1"]), ("p", "v2", 2, "main", "bob", at(2000), "bugfix", "minor", [(50, 2, 3)], [])]
    df = spark.createDataFrame(rows, "path string, version_id string, seq long, branch string, author string, ts timestamp_ntz, intent string, severity string, diffs array<struct<start_line:int,lines_removed:int,lines_added:int>>, linked_issues array<string>")
    s = doc_history.statistics(df).first()
    assert (s.versions, s.added, s.removed, s.net, s.authors, s.impact) == (2, 13, 7, 6, 2, 1.25)
    assert doc_history.blame(df, 3).first().author == "alice" and doc_history.blame(df, 20).count() == 0
    scores = spark.createDataFrame([(x,) for x in (0.29, 0.3, 0.6, 0.8)], "s double").select(doc_history.risk_level(F.col("s"))).collect()
    assert [r[0] for r in scores] == ["low", "medium", "high", "critical"]
    assert doc_history.statistics(df.limit(0)).first().versions == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", ""]), max_size=12), st.lists(st.sampled_from(["a", "b", "c", ""]), max_size=12))
def test_line_diff(a, b):
    old, new = "\n".join(a), "\n".join(b)
    assert patched(old, hunks_of(old, new)) == new.splitlines()


def test_text_scans(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    assert {x.kind for x in one("x' or '1'='1 ; cat /etc ../ <SCRIPT> Bearer abc", textscan.findings)} == {"sql_injection", "xss", "path_traversal", "command_injection", "sensitive_data"}
    assert one(None, textscan.findings) == [] and one("clean", textscan.findings) == []
    assert one('import "std/mem"\n  use foo::bar;\n#include <a.h>\nfrom x import y\nlet z', textscan.imports) == ["std/mem", "foo::bar", "a.h", "x"]
    assert one("foo(bar(x)) if (y) z = Baz.qux(1)", textscan.calls) == ["foo", "bar", "Baz.qux"]
    r = one("mail a.b@c.org or 123-45-6789", textscan.redacted)
    assert (r.text, r["count"]) == ("mail [EMAIL] or [SSN]", 2)
    assert one("see #12 and ABC-7 and #12", textscan.issue_references) == ["#12", "ABC-7"]
    assert one("My PassWord", textscan.sensitivity) == "restricted" and one(None, textscan.sensitivity) is None
    assert one("x" * 30, lambda c: textscan.windowed_summary(c, 9)) == "xxx\n...\nxxx\n...\nxxx" and one("ab", lambda c: textscan.windowed_summary(c, 9)) == "ab"
    assert one("ns:a:b", ids.parse_entity_id) == ("ns", "a:b") and one("none", ids.parse_entity_id) is None


def test_occurrences(spark, monkeypatch):
    rng = random.Random(8)
    dictionary = [("x", ["aa", "ab", "b", ""], True), ("y", ["AB", "aba"], False), ("z", ["aa"], True)]
    texts = ["".join(rng.choice("aAbBé ") for _ in range(rng.randrange(30))) for _ in range(60)] + ["", None, "aaaa"]
    df = spark.createDataFrame([(k % 50, t, k) for k, t in enumerate(texts)], "key int, text string, n int")
    want = sorted((k % 50, kind, n, body.count(n), body.index(n) + 1) for k, t in enumerate(texts) if t for kind, needles, cased in dictionary for n, body in ((x if cased else x.lower(), t if cased else t.lower()) for x in needles) if n and n in body)
    assert sorted(tuple(r) for r in textscan.occurrences(df, "key", "text", dictionary).collect()) == want
    assert textscan.occurrences(df.limit(0), "key", "text").collect() == [] and textscan.occurrences(df, "key", "text", []).collect() == []
    monkeypatch.setitem(sys.modules, "ahocorasick", None)  # without the package
    assert sorted(textscan._automaton({"aa", "ab"})("aaab")) == [(1, "aa"), (2, "aa"), (3, "ab")]


def test_ranking(spark):
    assert spark.createDataFrame([("a b b",)], "t string").select(ranking.overlap(F.col("t"), "b c b a")).first()[0] == 0.75
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.5, 0.9, 0.5, None])], "g int, i int, score double")
    assert [(r.i, r["rank"]) for r in ranking.ranked(df, ["g"], ["i"]).orderBy("rank").collect()] == [(1, 0), (0, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("big", [3, 10**6])
def test_ranking_in_blocks(spark, big):
    rng = random.Random(big)
    rows = [(rng.choice([1, 1, None]), i, rng.choice([None, float("nan"), 0.5, -0.0, 0.0, rng.random(), float("inf")]), "x" * rng.randrange(20)) for i in range(80)]
    df = spark.createDataFrame(rows, "g int, i int, score double, t string")
    order = lambda r: (r[2] is None, 0 if r[2] is None else (-1e400 if r[2] != r[2] else -r[2]), r[2] == r[2], r[1])
    groups = {g: sorted((r for r in rows if r[0] == g), key=order) for g in (1, None)}
    want = {r[1]: n for rs in groups.values() for n, r in enumerate(rs)}
    assert {r.i: r["rank"] for r in ranking.ranked(df, ["g"], ["i"], big=big).collect()} == want
    top = ranking.top_k_per(df, ["g"], 4, ["i"])
    assert {r.i: r["rank"] for r in top.collect()} == {i: n for i, n in want.items() if n < 4} and "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    for limit in (100, 5000):
        kept = set()
        for g in (1, None):
            own, used = [r for r in rows if r[0] == g], 0  # in the order of i
            if sum(len(r[3]) for r in own) <= limit:
                kept |= {r[1] for r in own}
            else:
                for r in own:
                    used += len(r[3]) + 10
                    kept |= {r[1]} if used <= limit else set()
        assert {r.i for r in ranking.summary_cutoff(df, ["g"], ["i"], "t", limit).collect()} == kept


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"\x01")), (2, None)], "i int, b binary")
    assert [json.loads(r.json) for r in export.as_json(df).orderBy("json").collect()] == [{"i": 1, "b": "01"}, {"i": 2}]
    for kind in ("parquet", "orc", "json", "csv"):
        export.write(export.printable(df), str(tmp_path / kind), kind)
        assert spark.read.format(kind).option("header", True).load(str(tmp_path / kind)).count() == 2
    for library in ("chartjs", "d3", "vega", "plotly", "echarts"):
        json.loads(export.chart(df, "i", "i", library))
    assert "<td>01</td>" in export.dashboard("t", [("p", export.printable(df))]) and export.dashboard("t", [("p", df)], "markdown").startswith("# t")
    lines = [r.line for r in export.openmetrics("counter", "hits", spark.createDataFrame([("a", 2)], "label string, value long")).orderBy("n").collect()]
    assert lines == ["# TYPE hits counter", 'hits{label="a"} 2']
    assert derived.migration_path([("1", "2"), ("2", "3"), ("1", "3")], "1", "3") == [("1", "3")] and derived.migration_path([], "1", "2") is None and derived.compatible((1, 2), (1, 1))


def test_extensions(spark):
    x = Extensions(spark)
    x.function("twice_of", "long", lambda s: s * 2)
    assert spark.sql("select twice_of(21L)").first()[0] == 42 and json.loads(x.schema_json("twice_of"))["returns"] == "long"
    x.hook("on_commit", lambda rows, context: rows.count())
    x.hook("on_commit", lambda rows, context: 1 / 0)
    (_, n), (_, error) = x.fire("on_commit", spark.range(3))
    assert n == 3 and isinstance(error, ZeroDivisionError)
    with pytest.raises(ValueError):
        x.hook("nothing", print)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(0, 100), max_size=40), st.integers(0, 40))
def test_token_bucket(times, cut):
    t = np.sort(np.array(times))
    whole, tokens, last = stateful.token_bucket(t, 0.5, 3.0, 3.0, 0.0)
    a, one, two = stateful.token_bucket(t[:cut], 0.5, 3.0, 3.0, 0.0)
    b, *end = stateful.token_bucket(t[cut:], 0.5, 3.0, one, two)
    assert [*a, *b] == [*whole] and end == [tokens, last]


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, at(i * 100 + rng.randrange(50)), rng.choice("ab"), float(i)) for i in range(200)], "event_id long, ts timestamp_ntz, k string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(3):
        df.where(F.floor(F.col("event_id") / 70) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "e.parquet"))
    stream = run.stream_table(spark, str(tmp_path), "e", files_per_batch=1)
    rows = lambda x: sorted(map(repr, x.collect()))
    assert rows(run.latest_per_key(windows.tumbling(stream, "10 minutes", ["k"], late="1 day"), ["k", "window_start"])) == rows(windows.tumbling(df, "10 minutes", ["k"]))
    assert rows(run.latest_per_key(windows.last_values(stream, ["k"]), ["k"])) == rows(windows.last_values(df, ["k"]))
    limited = run.appended(stateful.rate_limited(stream, "k", 1 / 300, 2.0))
    assert limited.count() == 200 and 0 < limited.where("allowed").count() < 200


def test_two_writers(spark, tmp_path):
    one, two = (CommitLog(spark, str(tmp_path / "log")) for _ in range(2))
    a, b = one.begin(), two.begin()
    a.put(b"k", b"a")
    b.put(b"k", b"b")
    assert a.commit() == 1
    with pytest.raises(CommitConflict):
        b.commit()
    assert one.get(b"k") == b"a" and two.frame().count() == 1
    late = two.begin()
    late.put(b"k", b"late")
    one.claim(2)  # another writer between its claim and its commit
    with pytest.raises(CommitConflict):
        late.commit()
    one.release(2)
    with pytest.raises(ValueError):
        one.release(1)
    again = two.begin()
    again.put(b"k", b"again")
    assert again.get(b"k") == b"again" and again.commit() == 2 and one.get(b"k") == b"again" and one.get(b"k", 1) == b"a"
    assert two.begin().commit() == 2


def test_long_shortest_path(spark):
    edges = spark.range(70).selectExpr("CAST(id AS INT) AS src", "CAST(id + 1 AS INT) AS dst", "1.0 AS strength", "id AS seq")
    pairs = spark.createDataFrame([(0, 66), (0, 3), (5, 4)], "src int, dst int")
    got = {(r.src, r.dst): (r.hops, r.path) for r in graph.shortest_paths(edges, pairs).collect()}
    assert got == {(0, 66): (66, list(range(67))), (0, 3): (3, [0, 1, 2, 3])}
    assert {r.dst for r in graph.shortest_paths(edges, pairs.where("src = 0"), max_hops=3).collect()} == {3}


def test_rate_limit_remembers_until_full(spark, tmp_path):
    batches = [[(1, 0, "a"), (2, 0, "a"), (3, 0, "a")], [(4, 1600, "b")], [(5, 1601, "b")], [(6, 1010, "a"), (7, 1011, "a")]]  # the watermark passes a's first requests by 1,000 s, of 1,200
    for rows in batches:
        df = spark.createDataFrame([(i, at(s), k) for i, s, k in rows], "event_id long, ts timestamp_ntz, k string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "e.parquet"))
    for files in (1, None):
        limited = run.appended(stateful.rate_limited(run.stream_table(spark, str(tmp_path), "e", files_per_batch=files), "k", 1 / 600, 2.0))
        assert {r.event_id for r in limited.where("allowed").collect()} == {1, 2, 4, 5, 6}
