"""Each query beside its SQL twin, on the smallest tables."""

import os
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from lodestrata.queries.catalog import core_registry  # noqa: E402

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")
REGISTRY = core_registry()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def con():
    from tools.compare import duck

    return duck(SF)


@pytest.mark.parametrize("name", list(REGISTRY.queries))
def test_query(spark, con, name):
    from tools.compare import plain

    df = REGISTRY.queries[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in REGISTRY.sql:
        cursor = con.execute(REGISTRY.sql[name])
        theirs, names = cursor.fetchall(), [d[0] for d in cursor.description]
        order = sorted(df.columns)
        assert order == sorted(names)
        assert Counter(tuple(plain(r[c]) for c in order) for r in rows) == Counter(tuple(plain(r[names.index(c)]) for c in order) for r in theirs)


@pytest.mark.parametrize("name", ["kv_snapshot_as_of_last", "kv_snapshot_diff_half", "kv_read_your_writes_half"])
def test_snapshots_of_the_whole_log(spark, tmp_path, name):
    # A key that is written only after transaction 200.
    rows = [(1, t, s, "put", k, f"{t}.{s}".encode()) for t, s, k in ((90, 0, b"a"), (180, 0, b"b"), (1500, 0, b"a"), (1500, 1, b"c"), (2900, 0, b"c"), (2900, 1, b"d"))] + [(9, 2901, 0, " DEL", b"b", None), (9, 2900, 1, "put", b"x", b"repeat")]
    spark.createDataFrame(rows, "feed_offset long, txn_id long, seq int, op string, key binary, value binary").write.parquet(f"{tmp_path}/kv_commits.parquet")
    got = {tuple(bytes.fromhex(v) if isinstance(v, str) and k.endswith("hex") else v for k, v in r.asDict().items() if k not in ("txn_id", "seq")) for r in REGISTRY.queries[name](spark, str(tmp_path)).collect()}
    last = {(b"a", b"1500.0"), (b"c", b"2900.0"), (b"d", b"2900.1")}
    assert got == ({(b"a", b"90.0", b"1500.0", "changed"), (b"b", b"180.0", None, "removed"), (b"c", None, b"2900.0", "added"), (b"d", None, b"2900.1", "added")} if name == "kv_snapshot_diff_half" else last)


def test_pii_redact_all(spark, tmp_path):
    import hashlib
    import random
    import re

    from lodestrata.functions.textscan import PERSONAL

    rng = random.Random(4)
    pieces = ["a.b+c@mail.example.org", "x@y", "123-45-6789", "1123-45-6789", "4111 1111 1111 1111", "4111-1111-1111-1111", "411111111111", "1 555 123 4567", "+44 207 9460 958", "555 1234", "näher", "\n", "Call", "é123-45-6789"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(200)] + ["m@n.de 123-45-6789 4111 1111 1111 1111, +1 555 123 4567"]
    spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in enumerate(texts):
        n = 0
        for pattern, name in PERSONAL:
            t, k = re.subn(pattern, name, t)
            n += k
        want[i] = (hashlib.md5(t.encode()).hexdigest(), n)
    got = {r.doc_id: (r.digest, r.redactions) for r in REGISTRY.queries["pii_redact_all"](spark, str(tmp_path)).collect()}
    assert got == want and want[200] == (hashlib.md5(b"[EMAIL] [SSN] [CARD], [PHONE]").hexdigest(), 4)


def test_field_delta_of_every_delivery(spark, tmp_path):
    states = {1: '{"a": 1}', 2: '{"a": 1, "b": 2}', 3: '{"b": 2.5}', 4: '{ "b": 2.5 }', 6: '{"b": {"c": 1}}', 7: '{"b": {"c": 1}}', 8: '{"b": {"c": 2}, "d": null}'}
    rows = [(n, "ns", "e", s, n) for n, s in states.items()] + [(8, "ns", "late", '{"a": 1}', 8), (6, "ns", "e", '{"z": 0}', 5)]
    spark.createDataFrame(rows, "delivery_no int, entity_namespace string, entity_local_id string, state_data string, s int").selectExpr("* except (s)", "timestamp_seconds(s) AS delivered_at").write.parquet(f"{tmp_path}/snapshot_deliveries.parquet")
    got = {(r.delivery_no, r.entity_local_id, r.field, r.change) for r in REGISTRY.queries["entity_field_delta_all"](spark, str(tmp_path)).collect()}
    assert got == {(2, "e", "b", "added"), (3, "e", "a", "removed"), (3, "e", "b", "modified"), (6, "e", "b", "modified"), (8, "e", "b", "modified"), (8, "e", "d", "added")}


def test_change_risk_in_blocks(spark):
    from lodestrata.operators.doc_history import change_risk
    from lodestrata.queries.records import versions_of

    versions = versions_of(spark, SF)
    whole, blocks = ({(r.path, r.version_id): (round(r.score, 12), r.level) for r in change_risk(versions, big).collect()} for big in (10**6, 2))
    assert whole == blocks and len(whole) == versions.count()
