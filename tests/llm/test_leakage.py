import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lodestrata.llm import leakage
from lodestrata.llm.leakage import ItemIndex, byte_words, leaked_items, words


def brute(documents, items, run=13):
    out = set()
    for item, text in items:
        ws = words(text)
        n = min(run, len(ws))
        grams = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if ws and item is not None else set()
        for doc, body in documents:
            bs = words(body)
            if doc is not None and any(tuple(bs[k : k + n]) in grams for k in range(len(bs) - n + 1)):
                out.add((doc, item))
    return out


def make(rng, vocabulary=30):
    word = lambda: rng.choice([f"w{rng.randrange(vocabulary)}", "The", "a"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 12, 13, 14, 30]))) for i in range(40)] + [(90, None), (91, ""), (92, "—"), (93, text(400)), (None, "w1 w2")]
    items += [(94, items[3][1]), (3, items[3][1])]
    documents = [(100, None), (101, ""), (102, " ".join(f"w{k % 7}" for k in range(3000))), (None, items[0][1])]
    for d in range(60):
        parts = [text(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            ws = words(rng.choice([t for _, t in items if t and words(t)]))
            k = rng.randrange(len(ws))
            cut = ws[k : k + rng.choice([4, 12, 13, 20, 200])]
            parts += [rng.choice([" x ", " ", "\n-- "]).join(cut).upper(), text(5)]
        documents.append((d, ", ".join(parts)))
    documents.append((5, documents[-1][1]))  # a key twice
    return documents, items


def longest(a, b):
    """Words of the longest common run of two word lists."""
    best, last = 0, []
    for w in a:
        now = [0] * (len(b) + 1)
        for k, x in enumerate(b):
            if x == w:
                now[k + 1] = (last[k] if last else 0) + 1
        best, last = max(best, *now), now
    return best


def indexed(items, run):
    return ItemIndex([(i, ws) for i, t in items if i is not None and (ws := byte_words(t))], run)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_byte_words(text):
    assert [w.decode() for w in byte_words(text)] == words(text)
    assert [w.decode() for w in byte_words("İK a" + text)] == words("İK a" + text) and byte_words(None) == []


@pytest.mark.parametrize("run", [1, 2, 13, 64, 65, 200])
def test_index(run, monkeypatch):
    documents, items = make(random.Random(run))
    monkeypatch.setattr(leakage, "CELLS", 500)
    found = indexed(items, run).leaks([byte_words(t) for _, t in documents])
    assert {(documents[k][0], i) for k, i in found if documents[k][0] is not None} == {x for x in brute(documents, items, run) if x[1] is not None}
    texts = {}
    for i, t in items:
        texts.setdefault(i, []).append(words(t))
    for (k, i), (length, score) in list(found.items())[:200]:
        assert length == max(longest(words(documents[k][1]), ws) for ws in texts[i] if ws), (k, i)
        assert score > 0.99


def test_a_whole_long_item():
    ws = [f"w{k}" for k in range(120)]
    index = ItemIndex([(7, [w.encode() for w in ws])], 80)
    assert index.leaks([byte_words("x " + " ".join(ws) + " y"), byte_words(" ".join(ws[:79])), byte_words(" ".join(ws[20:100]))]) == {(0, 7): (120, pytest.approx(1, abs=1)), (2, 7): (80, pytest.approx(1, abs=1))}


@pytest.mark.parametrize("n", range(16))
def test_short_batches(n):
    index = indexed([(1, "a b c d e f g h i j k l m n"), (2, "a"), (3, "b a")], 13)
    ws = "a b c d e f g h i j k l m n".split()[:n]
    assert {i for _, i in index.leaks([[w.encode() for w in ws]])} == {i for _, i in brute([(0, " ".join(ws))], [(1, "a b c d e f g h i j k l m n"), (2, "a"), (3, "b a")])}


def test_thresholds_lose_nothing():
    documents, items = make(random.Random(8), vocabulary=4000)
    index = indexed(items, 13)
    for k in range(len(index.ids)):
        theirs, n = index.flat[index.starts[k] : index.ends[k]].tolist(), index.need[k]
        for at in range(len(theirs) - n + 1):
            gram = np.unique(theirs[at : at + n])
            assert index._look(index.keys, index.weights, gram * len(index.ids) + k).sum() >= 1 - leakage.SLACK
            assert index._look(index.block_keys, index.most, gram * index.n_blocks + k // leakage.BLOCK).sum() >= 1 - leakage.SLACK
            pairs = index.pairs_of(np.array(theirs[at : at + n]))[:-1]
            slot = index.slot[n][theirs[at] if n == 1 else min(pairs, key=lambda x: index.rank[x])]
            assert k in index.list_items[n][index.list_starts[n][slot] : index.list_starts[n][slot + 1]]


def test_work_follows_matches():
    """The postings walked per passage don't grow with the items."""
    rng = random.Random(1)
    word = lambda: b"w%d" % int(2_000 * rng.random() ** 3)
    texts = [[word() for _ in range(3000)]]
    walked = []
    items = [(i, [word() for _ in range(40)]) for i in range(20_000)]
    texts[0] += [w for _, ws in items[:50] for w in ws]  # of items that both indexes have
    for n in (500, 20_000):
        index = ItemIndex(items[:n], 13)
        ids = np.array([index.vocabulary.get(w, len(index.vocabulary)) for w in texts[0]])
        pair = index.pairs_of(ids)
        _, _, pivots = index.passages(ids, pair, 13)
        slots = index.slot[13][pair[pivots]]
        walked.append(np.diff(index.list_starts[13])[slots[slots >= 0]].sum() / len(pivots))
    assert max(walked) < 2


@pytest.mark.parametrize("per_index", [2_000_000, 150])
def test_table(spark, monkeypatch, per_index):
    documents, items = make(random.Random(4))
    d = spark.createDataFrame([(*x, 1, "t") for x in documents], "doc_id long, text string, item_id int, score string")
    i = spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, doc_id string")
    want = {x for x in brute(documents, items) if x[1] is not None}
    monkeypatch.setattr(leakage, "INDEX_WORDS", per_index)  # several indexes and scans
    monkeypatch.setattr(leakage, "INDEXES_PER_SCAN", 2)
    rows = leaked_items(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) and all(r.run_words >= 1 and r.score > 0.99 for r in rows)
    assert leaked_items(d.limit(0), i).collect() == [] and leaked_items(d, i.limit(0)).collect() == []
    with pytest.raises(ValueError):
        leaked_items(d, i, run=0)
