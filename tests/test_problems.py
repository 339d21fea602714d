"""Problems 1 to 6 against plain Python, with nulls, ties, repeats, empty tables and clashing column names."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestrata.functions.jsonstate import canonical_json
from lodestrata.operators import entity_features, hierarchy, merkle, outranking
from lodestrata.operators.change_feed import apply_feed, latest_changes
from lodestrata.operators.entity_features import entity_type_stats, feature_table
from lodestrata.operators.hierarchy import descendants, hierarchies, key_number, number_key, solve_fragment
from lodestrata.operators.merkle import append_snapshot, changed_versions, validity
from lodestrata.operators.outranking import net_flow
from lodestrata.operators.snapshot_diff import neighbouring_changes

T0 = datetime(2024, 1, 1)


def ts(seconds):
    return T0 + timedelta(seconds=seconds)


# --- JSON ----------------------------------------------------------------------------------------------------------------------------


def test_canonical_json(spark):
    same = [('{"b":1,"a":{"y":[1,2],"x":null}}', '{ "a" : {"x":null,"y":[1, 2]}, "b":1}'), ('"\\u00e9\\/"', '"é/"'), ("[2.50]", "[2.5]"), ('{"a":5.0}', '{"a":5.00}'), ("[]", " [ ] ")]
    different = [("[1,2]", "[2,1]"), ('{"a":1}', '{"a":1.0}'), ('{"a":1}', '{"a":"1"}'), ('{"a":null}', "{}"), ('"a b"', '"a  b"'), ("not json", "not  json"), ('{"s":"5.0,"}', '{"s":"5,"}'), ("", " "), ("null", "nul"), ('{"a":1,"a":2}', '{"a":2}')]
    df = spark.createDataFrame([(a, b) for a, b in same + different], "a string, b string")
    got = [r[0] for r in df.select(canonical_json(F.col("a")) == canonical_json(F.col("b"))).collect()]
    assert got == [True] * len(same) + [False] * len(different)
    # Read once: neither many whole floats nor long strings and digits cost more than their length.
    long = [(k, "[" + ",".join([f"{k}.0", '"a\\"1.0,"', "1.50", "2.0e1", "-7.00"] * 40_000) + "]") for k in (3, 4)] + [(5, '["' + "x1.0," * 100_000), (6, "9" * 100_000)]
    texts = {r.k: r.c for r in spark.createDataFrame(long, "k int, t string").select("k", canonical_json(F.col("t")).alias("c")).collect()}
    assert texts[3].startswith('j[3.0,"a\\"1.0,",1.5,20.0,-7.0,3.0') and texts[3] != texts[4] and texts[5] == "t" + long[2][1]
    assert spark.createDataFrame([(None,)], "a string").select(canonical_json(F.col("a"))).first()[0] is None


# --- 1 -------------------------------------------------------------------------------------------------------------------------------

EVENTS = "actor_id long, event_type string, ts timestamp_ntz, event_id long, entity string, kind string, salt int, n long"


@pytest.mark.parametrize("share", [1e-9, 2.0])  # all groups heavy, none heavy
def test_features(spark, share):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        actor = 1 if rng.random() < 0.4 else rng.choice([None, 2, 3, 4])
        kind = rng.choice(["A", " a ", "b", "B ", "c\t", None, ""])
        row = (actor, kind, rng.choice([None, ts(rng.randrange(50))]), i, "x", "y", 1, 2)
        rows += [row] * rng.choice([1, 1, 3])
    want = {}
    for a, k, t, e, *_ in set(rows):
        if a is not None and k is not None and t is not None:
            want.setdefault((a, k.strip().lower()), []).append((t, e))
    df = spark.createDataFrame(rows, EVENTS)
    stats = entity_type_stats(df, heavy_share=share, salts=3, value=F.col("event_id") * 2.0)
    got = {(r.entity, r.kind): (r.n, r.first_ts, r.last_ts, r.last_event_id, r.total) for r in stats.collect()}
    assert got == {k: (len(v), min(v)[0], max(v)[0], max(v)[1], sum(2.0 * e for _, e in v)) for k, v in want.items()}
    wide = {r.entity: r for r in feature_table(stats, ["b", "A", "zz", None, "a"], F.lit(ts(100))).collect()}
    for actor in {a for a, _ in want}:
        own = {k: v for (a, k), v in want.items() if a == actor}
        r = wide[actor]
        assert list(r.counts) == [len(own.get(k, ())) for k in ("a", "b", "zz")]
        assert list(r.recency_s) == [int((ts(100) - max(own[k])[0]).total_seconds()) if k in own else None for k in ("a", "b", "zz")]
        assert r.n_events == sum(map(len, own.values())) and r.n_types == len(own) and r.other_events == sum(len(v) for k, v in own.items() if k not in "ab" or not k)


def test_features_empty(spark):
    df = spark.createDataFrame([], EVENTS)
    assert entity_type_stats(df).collect() == []
    assert feature_table(entity_type_stats(df), [], F.lit(ts(0))).collect() == []
    assert entity_features.MAX_HEAVY_GROUPS == 1000


# --- 2 and 3 -----------------------------------------------------------------------------------------------------------------------------

CAPTURES = "entity_namespace string, entity_local_id string, version long, ts timestamp_ntz, state_data string, received_at timestamp_ntz, branch_id string, key string, row int, `at` int, hash string"


def styled(rng, value):
    if value is None:
        return None
    keys = list(value)
    rng.shuffle(keys)
    return json.dumps({k: value[k] for k in keys}, separators=rng.choice([(",", ":"), (", ", ": ")]), ensure_ascii=rng.random() < 0.5)


@pytest.mark.parametrize("big", [2, 512])
def test_history(spark, monkeypatch, big):
    monkeypatch.setattr(merkle, "BIG", big)
    rng = random.Random(big)
    rows, truth = [], {}
    for e in range(30):
        key, state = (rng.choice(["n", None]), f"e{e}" if e else None), {"a": 1, "t": "é"}
        for v in sorted(rng.sample(range(-5, 40), rng.choice([1, 2, 20] if e else [30]))):
            if rng.random() < 0.5:
                state = rng.choice([None, {"a": rng.randrange(3), "t": "é"}, {"a": 1.0, "t": "é"}])
            truth.setdefault(key, {})[v] = None if state is None else json.dumps(state, sort_keys=True)
            now = rng.randrange(1000)
            rows.append((*key, v, ts(v * 10), styled(rng, state), ts(2000 + now), None, "k", 1, 2, "h"))
            rows += [(*key, v, ts(0), '{"old":1}', ts(now), None, "k", 1, 2, "h"), rows[-1], (*key, v, ts(0), '{"branch":1}', ts(9000), "b", "k", 1, 2, "h")]
    rows.append(("n", "nov", None, ts(0), "{}", ts(0), None, "k", 1, 2, "h"))
    want = set()
    for key, chain in truth.items():
        last = object()
        for v, s in sorted(chain.items()):
            if s != last:
                want.add((*key, v))
            last = s
    df = spark.createDataFrame(rows, CAPTURES)
    changes = changed_versions(df)
    assert {tuple(r) for r in changes.select("entity_namespace", "entity_local_id", "version").collect()} == want
    for depth in (1, 3):
        assert changed_versions(df, depth=depth, keep_state=False).count() == len(want)
    periods = validity(changes.withColumn("ts", F.when(F.col("version") % 7 == 0, F.lit(ts(-500))).when(F.col("version") % 11 != 0, F.col("ts")))).collect()
    chains = {}
    for r in sorted(periods, key=lambda r: r.version):
        chains.setdefault((r.entity_namespace, r.entity_local_id), []).append(r)
    for chain in chains.values():
        begun = None
        for r, after in zip(chain, [*chain[1:], None]):
            begun = max((t for t in (begun, r.ts) if t is not None), default=None)
            assert r.valid_from == begun and r.valid_to == (after and after.valid_from) and r.is_current == (after is None)
    assert sum(r.is_current for r in periods) == len(truth) and len(chains) == len(truth)
    assert changed_versions(df.limit(0)).collect() == []


def test_busy_key_of_sparse_versions(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BIG", 50)
    rows = [("n", "hot", v * 10**6, ts(v), str(v // 3), ts(0), None, "k", 1, 2, "h") for v in range(300)] + [("n", f"e{k}", 5, ts(0), "1", ts(0), None, "k", 1, 2, "h") for k in range(20)]
    df = spark.createDataFrame(rows, CAPTURES)
    blocked, within, split = merkle._chains(df.selectExpr("entity_local_id AS e", "version"), "e", "version", 300)
    assert split and blocked.groupBy(*within).count().agg(F.max("count")).first()[0] <= 50
    periods = validity(changed_versions(df)).collect()
    assert {r.version for r in periods if r.entity_local_id == "hot"} == {v * 10**6 for v in range(0, 300, 3)} and len(periods) == 120
    assert all(r.valid_to == (ts(r.version // 10**6 + 3) if r.version < 297 * 10**6 else None) for r in periods if r.entity_local_id == "hot")


def test_depth():
    assert [merkle.depth_for(n) for n in (0, 100, 4096, 4097, 10**5, 10**9, 10**15)] == [2, 2, 2, 3, 4, 7, 8]


def test_append_snapshot(spark):
    snap = lambda rows: spark.createDataFrame(rows, "key string, state string, valid_from int")
    day = lambda n: F.lit(ts(86400 * n)).cast("timestamp")
    first = snap([("a", '{"x":1}', 0), ("b", None, 0), ("c", "1", 0)])
    none = snap([])
    history = append_snapshot(spark.createDataFrame([], "key string, state string, valid_from timestamp, valid_to timestamp"), none, first, day(0))
    second = snap([("a", '{ "x" : 1 }', 0), ("b", "2", 0), ("d", None, 0)])
    history = append_snapshot(history, first, second, day(1))
    got = {(r.key, r.state, r.valid_from.day, r.valid_to and r.valid_to.day) for r in history.collect()}
    assert got == {("a", '{"x":1}', 1, None), ("b", None, 1, 2), ("b", "2", 2, None), ("c", "1", 1, 2), ("d", None, 2, None)}
    assert append_snapshot(history, second, second, day(2)).count() == 5


def test_deliveries(spark):
    rng = random.Random(5)
    rows, truth = [], {}
    for no in (1, 2, 4, 7):
        for e in range(40):
            if rng.random() < 0.7:
                state = rng.choice([None, {"a": rng.randrange(3), "b": [1, 2]}])
                key = (None if e == 3 else "n", None if e == 4 else f"e{e}")
                truth.setdefault(no, {})[key] = None if state is None else json.dumps(state, sort_keys=True)
                row = (no, ts(no * 10), *key, styled(rng, state), 9, 1)
                rows += [row] * rng.choice([1, 1, 2]) + ([(no, ts(no * 10 - 1), *key, '{"stale":1}', 9, 1)] if rng.random() < 0.2 else [])
    rows.append((None, ts(0), "n", "x", "{}", 1, 1))
    df = spark.createDataFrame(rows, "delivery_no int, delivered_at timestamp_ntz, entity_namespace string, entity_local_id string, state_data string, no int, `at` int")
    want = set()
    for before, no in ((1, 2), (2, 4), (4, 7)):
        a, b = truth[before], truth[no]
        want |= {(no, *k, "added") for k in b.keys() - a.keys()} | {(no, *k, "removed") for k in a.keys() - b.keys()} | {(no, *k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    assert {tuple(r) for r in neighbouring_changes(df).collect()} == want
    kept = neighbouring_changes(df, keep_state=True).collect()
    assert len(kept) == len(want) and all(r.old_state is None for r in kept if r.change_kind == "added")
    wide = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # the table is shuffled once, whatever the optimizer believes of sizes
        plan = neighbouring_changes(df)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", wide)
    assert neighbouring_changes(df.limit(0)).collect() == [] and neighbouring_changes(df.where("delivery_no = 1")).collect() == []


# --- 4 -------------------------------------------------------------------------------------------------------------------------------


def test_change_feed(spark):
    rng = random.Random(9)
    changes = {}
    for txn in range(60):
        for seq in range(rng.choice([1, 3])):
            key = b"hot" if rng.random() < 0.4 else rng.choice([b"", b"\xff\x00", b"k1", b"k2", b"k3"])
            changes[txn, seq] = (rng.choice(["put", "put", "del"]), key, rng.choice([None, b"", b"v%d" % txn]))
    state = {}
    for at, (op, key, value) in sorted(changes.items()):
        if op == "put":
            state[key] = (value, *at)
        else:
            state.pop(key, None)
    rows = []
    for (txn, seq), (op, key, value) in changes.items():
        rows += [(txn, seq, rng.choice([op, op.upper(), f" {op.title()} "]), bytearray(key), None if value is None else bytearray(value))] * rng.choice([1, 2])
    rows += [(None, 1, "put", bytearray(b"k1"), None), (99, None, "put", bytearray(b"k1"), None), (99, 1, "put", None, None), (99, 2, "merge", bytearray(b"k1"), None), (99, 3, None, bytearray(b"k1"), None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "feed_offset long, txn_id long, seq int, op string, key binary, value binary, age string, copy int")
    plain = lambda out: {bytes(r.key): (None if r.value is None else bytes(r.value), r.txn_id, r.seq) for r in out.collect()}
    assert plain(apply_feed(df)) == state
    early, late = df.where("txn_id < 30"), df.where("txn_id >= 30")
    assert plain(apply_feed(late, apply_feed(early))) == state
    assert plain(apply_feed(early, apply_feed(df))).items() >= state.items()  # older changes don't win
    assert apply_feed(df.limit(0)).collect() == [] and plain(apply_feed(df.limit(0), apply_feed(df))) == state
    assert latest_changes(df).groupBy("key").count().where("count > 1").isEmpty()


# --- 5 -------------------------------------------------------------------------------------------------------------------------------


def forest_truth(parents):
    out = {}
    for node in parents:
        path, at = [node], parents[node]
        while at is not None and at in parents and at not in path:
            path.append(at)
            at = parents[at]
        if at is not None and at in parents:
            ring = path[path.index(at) :]
            out[node] = (None, None, min(ring), None)
        else:
            out[node] = (path[-1], len(path) - 1, None, path[::-1])
    return out


def random_forest(rng, n):
    names = [f"n{i:03d}" for i in range(n)]
    rng.shuffle(names)
    parents = {}
    for i, name in enumerate(names):
        roll = rng.random()
        parents[name] = None if roll < 0.05 else "gone" if roll < 0.1 else name if roll < 0.12 else rng.choice(names) if roll < 0.2 else names[max(0, i - rng.choice([1, 1, 1, 5]))] if i else None
    return parents


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 40))
def test_fragment(seed, n):
    parents = random_forest(random.Random(seed), n)
    ids = np.array(list(parents), object)
    x = solve_fragment(ids, np.array([parents[i] for i in ids], object), ids.copy(), np.zeros(n, np.int64), [[] for _ in ids])
    truth = forest_truth(parents)
    for r in x.itertuples():
        root, depth, cycle, path = truth[r.id]
        assert (r.cycle if isinstance(r.cycle, str) else None) == cycle
        if root is not None:
            assert (r.top, r.hops, [*r.chain[::-1], r.id]) == (root, depth, path)
            assert r.exit == (parents[root] if parents[root] == "gone" else None)


@pytest.mark.parametrize("size", [25, 1000])
def test_hierarchies(spark, monkeypatch, size):
    monkeypatch.setattr(hierarchy, "FRAGMENT_ROWS", size)  # small fragments: the forest is solved over several levels
    parents = random_forest(random.Random(size), 120)
    star = {f"s{i:02d}": "s00" for i in range(1, 60)} | {"s00": None}
    parents |= star
    rows = [(i, p, "x", 1, "c") for i, p in parents.items()]
    rows += rows[:10] + [(None, "n001", "x", 1, "c")]
    df = spark.createDataFrame(rows, "id string, parent string, exit string, hops int, chain string")
    tree = hierarchies(df)
    truth = forest_truth(parents)
    got = {r.id: (r.root, r.depth, r.cycle_id, r.path) for r in tree.collect()}
    assert got == truth
    pairs = {(a, n, len(t[3]) - 1 - k) for n, t in truth.items() if t[3] for k, a in enumerate(t[3][:-1])}
    assert {tuple(r) for r in descendants(tree).collect()} == pairs
    assert {r.id: r.cycle_id for r in hierarchies(df, paths=False).collect()} == {n: t[2] for n, t in truth.items()}
    assert hierarchies(df.limit(0)).collect() == []


def test_long_chain(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "FRAGMENT_ROWS", 120)
    rng = random.Random(1)
    names = [f"{rng.random():.9f}" for _ in range(300)]
    df = spark.createDataFrame(list(zip(names, [*names[1:], None])), "id string, parent string")
    got = {r.id: r.depth for r in hierarchies(df, paths=False).collect()}
    assert got == {n: 299 - i for i, n in enumerate(names)}
    ring = spark.createDataFrame(list(zip(names, [*names[1:], names[0]])), "id string, parent string")
    assert {(r.depth, r.cycle_id) for r in hierarchies(ring).collect()} == {(None, min(names))}


def test_number_keys(spark):
    numbers = [-(2**63), -5, 0, 7, 10, 2**63 - 1]
    rows = spark.createDataFrame([(x,) for x in numbers], "x long").select("x", number_key(F.col("x")).alias("k")).select("x", "k", key_number(F.col("k")).alias("y")).collect()
    assert [r.x for r in sorted(rows, key=lambda r: r.k)] == numbers and all(r.x == r.y for r in rows)


# --- 6 -------------------------------------------------------------------------------------------------------------------------------


def flow_truth(rows, names, q, p):
    groups = {}
    for g, i, values in rows:
        groups.setdefault(g, {})[i] = values
    out = {}
    for g, items in groups.items():
        net = dict.fromkeys(items, 0.0)
        for k in range(len(names)):
            have = {i: v[k] for i, v in items.items() if v[k] is not None and v[k] == v[k]}
            n = len(have)
            pct = {i: (sum(w < v for w in have.values()) + sum(w == v for w in have.values()) / 2) / n for i, v in have.items()}
            ramp = lambda d: min(1.0, max(0.0, (d - q) / (p - q)))
            for i in have:
                net[i] += sum(ramp(pct[i] - pct[j]) - ramp(pct[j] - pct[i]) for j in have) / max(1, len(items) - 1) / len(names)
        ranked = sorted(net, key=lambda i: (-round(net[i], 12) + 0.0, i))
        out |= {(g, i): (net[i], ranked.index(i) + 1) for i in items}
    return out


@pytest.mark.parametrize("big", [5, 100_000])
def test_net_flow(spark, monkeypatch, big):
    monkeypatch.setattr(outranking, "BLOCKS", 8)
    rng = random.Random(big)
    names, rows = ["confidence", "recency"], []
    for g, n in ((1, 60), (2, 1), (3, 7), (4, 3)):
        for i in range(n):
            value = lambda: rng.choice([None, float("nan"), 0.5, 0.5, -0.0, 0.0, float("inf"), -1e30, rng.random(), rng.random() * 1e6])
            rows.append((g, i, (value(), 1.0 if g == 4 else value())))
    data = [(g, i, *v, ts(5), 1.0, 2) for g, i, v in rows] + [(g, i, 3.3, 4.4, ts(1), 1.0, 2) for g, i, _ in rows[:20]] + [(None, 1, 1.0, 1.0, ts(1), 1.0, 1), (1, None, 1.0, 1.0, ts(1), 1.0, 1)]
    df = spark.createDataFrame(data, "query_id long, result_id long, confidence double, recency double, computed_at timestamp_ntz, v double, block int")
    got = {(r.query_id, r.result_id): (r.net_flow, r.position) for r in net_flow(df, {"confidence": 1, "recency": 1}, big=big).collect()}
    want = flow_truth(rows, names, outranking.INDIFFERENT, outranking.PREFERRED)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0], abs=1e-9) and got[k][1] == want[k][1], k
    assert net_flow(df.limit(0), {"confidence": 1, "recency": 1}).collect() == []


@pytest.mark.parametrize("big", [5, 100_000])
def test_net_flow_of_text_ids(spark, monkeypatch, big):
    monkeypatch.setattr(outranking, "CHUNK", 16)
    rng = random.Random(2)
    rows = [(g, f"item-{i:03d}-é", (rng.choice([0.1, 0.2, 0.3]),)) for g in ("a", "b", "c", "d") for i in rng.sample(range(300), rng.choice([1, 30, 60]))]
    df = spark.createDataFrame([(g, i, *v) for g, i, v in rows], "query_id string, result_id string, confidence float")
    got = {(r.query_id, r.result_id): r.position for r in net_flow(df, {"confidence": 1}, latest=None, big=big).collect()}
    assert got == {k: v[1] for k, v in flow_truth(rows, ["confidence"], outranking.INDIFFERENT, outranking.PREFERRED).items()}


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 25), st.sampled_from([(0.02, 0.3), (0.0, 1.0), (0.5, 3.0)]))
def test_group_flows(seed, n, limits):
    rng = random.Random(seed)
    group = np.sort(np.array([rng.randrange(3) for _ in range(n)], np.int64))
    group = np.unique(group, return_inverse=True)[1] if n else group
    values = np.array([rng.choice([float("nan"), 1.0, 2.0, rng.random()]) for _ in range(n)])
    flows = outranking.group_flows(group, values, *limits)
    rows = [(int(g), i, (float(v),)) for i, (g, v) in enumerate(zip(group, values))]
    want = flow_truth(rows, ["x"], *limits)
    for g, i, _ in rows:
        others = max(1, int((group == g).sum()) - 1)
        assert flows[i] / others == pytest.approx(want[g, i][0], abs=1e-9)
