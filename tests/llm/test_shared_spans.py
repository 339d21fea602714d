import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lodestrata.llm import shared_spans
from lodestrata.llm.shared_spans import code_points, components, merged, pairs_within, shared_clusters, shared_coverage, shared_pairs, shared_windows, signatures, signed_runs, sliding_least, window_hashes


def brute(rows, span):
    windows = defaultdict(set)
    for d, t in rows:
        if d is not None and t is not None:
            for k in range(len(t) - span + 1):
                windows[t[k : k + span]].add(d)
    return {p for s in windows.values() for p in itertools.combinations(sorted(s), 2)}


def make(rng):
    letters = "abcdé版🙂 \n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(n) for n in (280, 299, 300, 301, 350, 700)] + ["-" * 400]
    rows = [(1000, None), (1001, ""), (1002, " " * 900), (1003, "x" * 299), (1004, "x" * 299), (None, "-" * 500)]
    for d in range(50):
        parts = [text(rng.randrange(200)), *itertools.chain.from_iterable((rng.choice(shared), text(rng.randrange(1, 80))) for _ in range(rng.randrange(3)))]
        rows.append((d, "".join(parts)))
    return rows + [(60, rows[-1][1]), (61, rows[-1][1]), (20, rows[20][1])]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 20))
def test_sliding_least(xs, size):
    x = np.array(xs, np.uint64)
    want = [min(xs[k : k + size]) for k in range(len(xs) - size + 1)]
    if want:
        assert sliding_least(x, size).tolist() == want


def test_window_hashes():
    text = "abcabcabcdabc版abc版"
    hashes = window_hashes(code_points(text), 4)
    for i, j in itertools.combinations(range(len(hashes)), 2):
        assert (hashes[i] == hashes[j]) == (text[i : i + 4] == text[j : j + 4])
    assert len(window_hashes(code_points("abc"), 4)) == 0


def test_signatures_lose_nothing():
    rng = random.Random(1)
    texts = [t for _, t in make(rng) if t and len(t) >= 300]
    own, sig, _ = signatures(texts)
    of = defaultdict(set)
    for i, s in zip(own.tolist(), sig.tolist()):
        of[i].add(s)
    for a, b in brute(list(enumerate(texts)), 300):
        assert of[a] & of[b]


def test_runs_hold_every_window():
    texts = [t for _, t in make(random.Random(2)) if t and len(t) >= 300] + ["0123456789" * 90, "ab" * 300 + "c" * 40]
    held = defaultdict(list)
    for i, first, last in zip(*(x.tolist() for x in np.array(signed_runs(texts), dtype=object)[[0, 2, 3]])):
        held[i] += range(first, last + 1)
    assert held == {i: list(range(len(t) - 299)) for i, t in enumerate(texts)}


def periodic(rng):
    """Texts of rulers, table borders and repeated lines: runs of one signature of any length."""
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for k in range(0, 80, 10):
        line, tail = text(60), text(45)
        rows += [(k, (line * 12)[20:720] + tail), (k + 1, (line * 12)[455:720] + tail + text(30))]  # 310 characters in common, at the end of a run of 400 windows
        rows += [(k + 2 + j, text(20) + line * 6 + text(20)) for j in range(4)]
    ruler, tail = "=" * 1000, text(110)
    rows += [(100, ruler + tail), (101, text(50) + "=" * 200 + tail)] + [(102 + j, text(80) + "=" * 210 + text(80)) for j in range(12)]
    return rows


@pytest.mark.parametrize("crowd", [1, 2, 100, 10**9])
def test_periodic_texts(spark, crowd):
    rows = periodic(random.Random(5))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in shared_pairs(df, crowd=crowd).collect()}
    assert got == brute(rows, 300) and all((k, k + 1) in got for k in range(0, 80, 10)) and (100, 101) in got


@pytest.mark.parametrize("crowd", [1, 100])
def test_near_misses_only(spark, crowd):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core = text(295)
    df = spark.createDataFrame([(k, text(40) + core + text(40)) for k in range(6)], "doc_id long, text string")
    assert shared_pairs(df, crowd=crowd).collect() == [] and shared_clusters(df, crowd=crowd).collect() == []
    assert {r.shared_chars for r in shared_coverage(df, crowd=crowd).collect()} == {0}
    assert shared_coverage(df.limit(0)).collect() == [] and shared_clusters(df.limit(0)).collect() == []


def test_long_texts_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    texts = ["".join(rng.choice("abcd") for _ in range(n)) for n in (299, 300, 301, 1000, 1299, 1300, 3456)]
    whole = {(i, s, k) for i, s, f, l in zip(*(x.tolist() for x in signed_runs(texts))) for k in range(f, l + 1)}
    hashes = [window_hashes(code_points(t), 300).tolist() for t in texts]
    monkeypatch.setattr(shared_spans, "PORTION", 500)
    assert [window_hashes(code_points(t), 300).tolist() for t in texts] == hashes
    names = {shared_spans._digest(t): i for i, t in enumerate(texts)}
    pieces = set()
    for part in shared_spans._portions(iter([pa.RecordBatch.from_arrays([pa.array(texts + texts)], ["text"])]), 300):
        assert all(len(piece) < 800 for *_, piece in part)
        for i, s, f, l in zip(*(x.tolist() for x in signed_runs([piece for *_, piece in part]))):
            assert texts[names[part[i][0]]][part[i][1] :].startswith(part[i][2])
            pieces |= {(names[part[i][0]], s, part[i][1] + k) for k in range(f, l + 1)}
    assert pieces == whole


def test_merged_and_pairs_within(spark, monkeypatch):
    assert merged([(5, 9), (0, 2), (3, 3), (20, 21), (6, 7)]) == [(0, 3), (5, 9), (20, 21)] and merged([]) == []
    monkeypatch.setattr(shared_spans, "SLICE", 3)
    rows = [(g, m) for g, n in ((1, 20), (2, 1), (3, 2), (4, 7)) for m in range(n)]
    got = [tuple(r) for r in pairs_within(spark.createDataFrame(rows, "g int, m long"), "g", "m").collect()]
    assert sorted(got) == sorted(p for n in (20, 1, 2, 7) for p in itertools.combinations(range(n), 2))


def test_shared_windows():
    assert shared_windows("xxabcdefyy", "zabcdefz", 4) == [(2, 8)]
    assert shared_windows("abcd", "dcba", 4) == [] and shared_windows("ab", "ab", 4) == []
    assert shared_windows("abcdXbcde", "abcdYbcde", 4) == [(0, 4), (5, 9)]
    assert shared_windows("abcde", "abcd-bcde", 4) == [(0, 4), (1, 5)]  # both stand in b, but not together


@pytest.mark.parametrize("crowd", [1, 2, 100, 10**9])
def test_pairs(spark, crowd):
    rows = make(random.Random(crowd % 97))
    df = spark.createDataFrame([(d, t, "c", 1, 2.0) for d, t in rows], "doc_id long, text string, cls string, sig int, a double")
    got = [tuple(r) for r in shared_pairs(df, crowd=crowd).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 300)
    assert shared_pairs(df.limit(0)).collect() == []


@pytest.mark.parametrize("crowd", [1, 2, 10**9])
def test_coverage_and_clusters(spark, crowd):
    rows = make(random.Random(7))
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, links int").distinct()
    unique = {d: t for d, t in rows if d is not None}
    where = defaultdict(set)
    for d, t in unique.items():
        for k in range(len(t or "") - 299):
            where[t[k : k + 300]].add(d)
    got = {r.doc_id: r for r in shared_coverage(df, crowd=crowd).collect()}
    assert got.keys() == unique.keys()
    for d, t in unique.items():
        covered = set()
        for k in range(len(t or "") - 299):
            if where[t[k : k + 300]] != {d}:
                covered |= set(range(k, k + 300))
        assert got[d].shared_chars == len(covered), d
        assert got[d].n_chars == (None if t is None else len(t))
    assert got[1000].class_id is None and got[61].class_id == got[60].class_id
    boss = {d: d for d in unique}

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    pairs = brute(rows, 300)
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        boss[y] = x
    inside = {d for p in pairs for d in p}
    clusters = {r.doc_id: (r.cluster_id, r.keep) for r in shared_clusters(df, crowd=crowd).collect()}
    assert clusters == {d: (find(d), find(d) == d) for d in inside}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(50, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    boss = {x: x for p in links for x in p}

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        boss[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {x: find(x) for p in links for x in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "a int, b int")).collect() == []
