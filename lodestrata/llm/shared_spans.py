"""Long exact spans that stand in more than one record: MinHash over sliding windows, exact verification, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lodestrata.plans.bounded import broadcast_if_bounded
from lodestrata.plans.lineage import cut

#: Characters of a span, and of the shingles whose least hash signs each window of so many characters.
SPAN, SHINGLE = 300, 200
#: Texts that may share a signature and still be compared pair by pair; those of a larger crowd meet under whole windows.
CROWD = 8
#: Characters hashed at once, which bounds a task's arrays (some 50 bytes each); longer texts are taken in overlapping pieces.
PORTION = 1_000_000
#: Members of a group that one task pairs with all others of the group.
SLICE = 2_048

_ODD = 0x9E3779B97F4A7C15
_MASK = 2**64 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    n = len(codes)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(77)) * _powers(_ODD, n), out=sums[1:])
        return _mix((sums[size:] - sums[:-size]) * _powers(pow(_ODD, -1, 2**64), n - size + 1))


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of ``size`` code points: equal windows have equal hashes wherever they stand."""
    n = max(0, len(codes) - size + 1)
    parts = [_hashes(codes[k : min(k + PORTION, n) + size - 1], size) for k in range(0, n, PORTION)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours, by doubling."""
    reach = 1
    while reach * 2 <= size:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (size - reach)], x[size - reach :]) if size > reach else x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def signed_runs(texts: list[str], span: int = SPAN, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, signature, first, last``: each window's least shingle hash, once per run of windows that have it in common.

    Two equal windows of ``span`` characters hold the same shingles, so they have the same signature: no shared span is missed.
    ``first`` and ``last`` are the positions of the run's windows. A run of periodic text is of any length, as its least shingle recurs.
    """
    codes = [code_points(t) for t in texts]
    size = np.array([len(c) for c in codes])
    ends = np.cumsum(size)
    least = sliding_least(window_hashes(np.concatenate(codes), shingle), span - shingle + 1)
    own = np.repeat(np.arange(len(codes)), size)[: len(least)]
    inside = np.arange(len(least)) + span <= ends[own]  # the window ends within its text
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1])
    begins = np.flatnonzero(new)
    last = np.minimum(np.append(begins[1:], len(least)) - 1, ends[own[begins]] - span)
    at, last = begins[inside[begins]], last[inside[begins]]
    offset = (ends - size)[own[at]]
    return own[at], least[at].view(np.int64), (at - offset).astype(np.int32), (last - offset).astype(np.int32)


def signatures(texts: list[str], span: int = SPAN, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, signature, position`` of :func:`signed_runs`; the position is the first of the run's windows."""
    return signed_runs(texts, span, shingle)[:3]


def shared_windows(a: str, b: str, span: int = SPAN) -> list[tuple[int, int]]:
    """The stretches (start, end) of ``a`` that are made of windows of ``span`` characters which stand in ``b`` too, exactly."""
    x, y = window_hashes(code_points(a), span), window_hashes(code_points(b), span)
    hits = np.flatnonzero(np.isin(x, y))
    if not len(hits):
        return []
    runs = np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1)
    out: list[tuple[int, int]] = []
    for run in runs:
        first, last = int(run[0]), int(run[-1])
        if a[first : last + span] in b:  # neighbouring windows that are neighbours in b too: one stretch
            out.append((first, last + span))
        else:
            out.extend((i, i + span) for i in map(int, run) if a[i : i + span] in b)
    return out


def _text_class(text: F.Column) -> F.Column:
    """128 bits that stand for a text: exact copies are one class."""
    return F.unhex(F.md5(text))


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def _portions(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[list[tuple[bytes, int, str]]]:
    """The distinct texts of a task as ``(class, offset, piece)``, in portions; copies within the task are hashed once.

    A text longer than PORTION comes in pieces that overlap by a span less one character, so that each window is in one piece.
    """
    seen: set[bytes] = set()
    part, size = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            name = _digest(text)
            if name in seen:
                continue
            if len(seen) > 1_000_000:
                seen.clear()
            seen.add(name)
            for at in range(0, len(text) - span + 1, PORTION):
                part.append((name, at, text[at : at + PORTION + span - 1]))
                size += len(part[-1][2])
                if size >= PORTION:
                    yield part
                    part, size = [], 0
    if part:
        yield part


def _sign(texts: DataFrame, span: int, shingle: int) -> DataFrame:
    """``cls, sig, at`` of each signature of the texts; ``at`` has the ``first`` and ``last`` window of a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches, span):
            own, sig, first, last = signed_runs([piece for *_, piece in part], span, shingle)
            offset = np.array([at for _, at, _ in part], np.int32)[own]
            at = pa.StructArray.from_arrays([pa.array(first + offset), pa.array(last + offset)], ["first", "last"])
            yield pa.RecordBatch.from_arrays([pa.array([name for name, *_ in part], pa.binary()).take(pa.array(own)), pa.array(sig), at], ["cls", "sig", "at"])

    return texts.mapInArrow(run, "cls binary, sig long, at struct<first:int,last:int>")


def merged(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of positions (first, last), overlapping and neighbouring ones joined."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _windows(texts: DataFrame, span: int) -> DataFrame:
    """``cls, sig, at`` of every window in the runs ``ats`` of ``texts`` (``cls, text, ats``): its digest, and where it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, text, ats in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for first, last in merged((x["first"], x["last"]) for x in ats):
                    for k in range(first, last + 1, 50_000):
                        spots = range(k, min(last + 1, k + 50_000))
                        names = pa.array([_digest(text[i : i + span]) for i in spots], pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array([cls] * len(spots), pa.binary()), names, pa.array(spots, pa.int32())], ["cls", "sig", "at"])

    return texts.mapInArrow(run, "cls binary, sig binary, at int")


def _met(keys: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``sig, cls, ats`` of the signatures that at least two classes have, each class once.

    Counting signatures merges before the shuffle, so that one that a third of all texts have is no burden; few of them occur twice,
    and only their rows move with their classes.
    """
    twice = cut(keys.groupBy("sig").count().where("count > 1").select("sig"))
    once = cut(keys.join(broadcast_if_bounded(twice, max_rows), "sig", "left_semi").groupBy("sig", "cls").agg(F.collect_set("at").alias("ats")))
    alone = once.groupBy("sig").count().where("count = 1").select("sig")  # of copies of one text
    return cut(once.join(broadcast_if_bounded(alone, max_rows), "sig", "left_anti"))


def pairs_within(rows: DataFrame, group: str, member: str) -> DataFrame:
    """``x, y`` of each two members of a group, ``x`` the smaller; a member may be listed once in a group.

    A large group is cut into slices of about SLICE members; each slice meets the whole group in a key of its own.
    """
    sizes = rows.groupBy(group).count().where("count > 1")
    placed = rows.join(sizes, group).withColumn("slices", F.ceil(F.col("count") / SLICE).cast("int"))
    left = placed.select(group, F.pmod(F.xxhash64(member), "slices").cast("int").alias("slice"), F.col(member).alias("x"))
    right = placed.select(group, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col(member).alias("y"))
    return left.join(right, [group, "slice"]).where("x < y").select("x", "y")


_STRETCHES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _verified(pairs: DataFrame, span: int) -> DataFrame:
    """``a, b, of_a, of_b`` of the ``pairs`` (``a, b, ta, tb``) whose texts share a span, with the stretches of each that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sides = [], ([], [])
            for k in range(batch.num_rows):
                p, q = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                if of_a := shared_windows(p, q, span):
                    kept.append(k)
                    for side, spans in zip(sides, (of_a, shared_windows(q, p, span))):
                        side.append([{"start": i, "end": j} for i, j in spans])
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(side, _STRETCHES) for side in sides)], ["a", "b", "of_a", "of_b"])

    stretch = "array<struct<start:int,end:int>>"
    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, f"a binary, b binary, of_a {stretch}, of_b {stretch}")


def span_links(texts: DataFrame, span: int = SPAN, shingle: int = SHINGLE, crowd: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What different texts have in common: verified pairs, and shared windows. ``texts`` has ``text``; classes are of exact copies.

    Windows are signed by MinHash, of one hash, which equal windows share for certain. Texts that meet under a signature of at
    most ``crowd`` texts (CROWD by default) are compared in pairs, character by character: ``a, b`` with ``of_a`` and ``of_b``, the
    stretches that they share. Larger crowds, as of boilerplate, form no pairs: every window of their stretches is taken, and
    ``sig, cls, ats`` lists those, by digest, that stand in at least two texts, and where. Each shared window is in one of the two.
    """
    crowd = CROWD if crowd is None else crowd
    long = texts.where(F.length("text") >= span).select("text")
    signed = _met(_sign(long, span, shingle))
    busy = broadcast_if_bounded(signed.groupBy("sig").count().where(F.col("count") > crowd).select("sig"))
    concerned = signed.select("cls").distinct()
    held = long.withColumn("cls", _text_class(F.col("text"))).join(broadcast_if_bounded(concerned), "cls", "left_semi")
    held = cut(held.groupBy("cls").agg(F.first("text").alias("text")))
    few = signed.join(busy, "sig", "left_anti").select("sig", "cls")
    meetings = few.select("sig", F.col("cls").alias("a")).join(few.select("sig", F.col("cls").alias("b")), "sig").where("a < b").select("a", "b").distinct()
    side = lambda n: held.select(F.col("cls").alias(n), F.col("text").alias(f"t{n}"))
    pairs = cut(_verified(meetings.join(side("a"), "a").join(side("b"), "b"), span))
    spots = signed.join(busy, "sig", "left_semi").groupBy("cls").agg(F.flatten(F.collect_list("ats")).alias("ats"))
    return pairs, _met(_windows(held.join(spots, "cls").select("cls", "text", "ats"), span))


def _members(documents: DataFrame, key: str, text: str, span: int) -> DataFrame:
    """``cls, id`` of each document whose text is long enough."""
    return documents.where(documents[key].isNotNull() & (F.length(documents[text]) >= span)).select(_text_class(documents[text]).alias("cls"), documents[key].alias("id"))


def shared_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, shingle: int = SHINGLE, crowd: int | None = None) -> DataFrame:
    """``doc_id_a, doc_id_b``, the smaller first: each pair of different documents that share ``span`` consecutive characters.

    Characters are Unicode code points and must be equal exactly. Texts are read whole. Exact copies are searched once and pair
    with each other, and with what their text pairs with, at the end. Of windows that the same texts share one is expanded. Null and
    shorter texts have no pairs, rows without key are ignored, repeated rows of a key are one document, other columns are
    ignored, empty tables give no rows.
    """
    pairs, windows = span_links(documents.select(documents[text].alias("text")), span, shingle, crowd)
    members = _members(documents, key, text, span).distinct()
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "cls")).alias(f"x{seed}") for seed in (1, 2)]
    sets = windows.groupBy("sig").agg(F.count("*").alias("n"), *marks).groupBy("n", "x1", "x2").agg(F.min("sig").alias("sig"))
    chosen = cut(windows.select("sig", "cls").join(broadcast_if_bounded(sets.select("sig")), "sig", "left_semi"))
    crowded = pairs_within(chosen, "sig", "cls")
    linked = pairs.select("a", "b").union(crowded).distinct()
    # Only members of linked classes, or of classes with copies, are needed.
    left, right = members.select(F.col("cls").alias("a"), F.col("id").alias("p")), members.select(F.col("cls").alias("b"), F.col("id").alias("q"))
    across = linked.join(left, "a").join(right, "b").select("p", "q").where("p != q")
    within = pairs_within(members, "cls", "id")
    both = across.select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b")).union(within)
    return both.distinct()  # a key with several texts may pair twice


def shared_coverage(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, shingle: int = SHINGLE, crowd: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_chars, shared_chars``.

    ``class_id`` is the smallest key with the same text; ``shared_chars`` counts the characters that lie in a span of at least ``span``
    which stands in another document too, each once; a copied text of that length counts whole. Null texts have null ``n_chars``, no
    class, and share nothing. Repeated rows of a key stay rows. No pairs of a crowd are formed: its shared windows are swept text by text.
    """
    pairs, windows = span_links(documents.select(documents[text].alias("text")), span, shingle, crowd)
    sides = pairs.select(F.col("a").alias("cls"), F.explode("of_a").alias("s")).union(pairs.select("b", F.explode("of_b"))).select("cls", "s.start", "s.end")
    sides = sides.union(windows.select("cls", F.explode("ats").alias("start")).select("cls", "start", F.col("start") + span))
    ends = W.partitionBy("cls").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    stretches = sides.distinct().withColumn("reached", F.coalesce(F.max("end").over(ends), F.lit(0)))
    covered = stretches.groupBy("cls").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).alias("covered"))
    rows = documents.where(documents[key].isNotNull()).select(documents[key].alias("doc_id"), _text_class(documents[text]).alias("cls"), F.length(documents[text]).cast("long").alias("n_chars"))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.max("doc_id").alias("other"))
    joined = rows.join(classes, "cls", "left").join(covered, "cls", "left")
    shared = F.when((F.col("other") != F.col("class_id")) & (F.col("n_chars") >= span), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)).cast("long"))
    return joined.select("doc_id", "class_id", "n_chars", shared.alias("shared_chars"))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node) of each node of ``links`` (``a, b``), by alternating large and small stars.

    Each round hooks the neighbours of a node to the smallest of them; nodes' neighbourhoods are aggregated and joined, never gathered.
    """
    edges = cut(links.where("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    before = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi != lo").distinct()
        edges = cut(small)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state == before:
            break
        before = state
    # At rest every node hangs on the smallest of its component.
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select(F.col("lo"), F.col("lo")).distinct())


def shared_clusters(documents: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, shingle: int = SHINGLE, crowd: int | None = None) -> DataFrame:
    """``doc_id, cluster_id, keep`` of each document that shares a span with another, or is copied: documents linked by shared spans form
    a cluster, named by its smallest key, which is the one that removal keeps.

    The texts of a crowd's window hang on the least of them, as a star.
    """
    pairs, windows = span_links(documents.select(documents[text].alias("text")), span, shingle, crowd)
    stars = windows.join(windows.groupBy("sig").agg(F.min("cls").alias("b")), "sig").select(F.col("cls").alias("a"), "b")
    members = _members(documents, key, text, span).distinct()
    classes = members.groupBy("cls").agg(F.count("*").alias("copies"))
    linked = components(pairs.select("a", "b").union(stars)).select(F.col("node").alias("cls"), "component")
    rows = members.join(classes, "cls").join(linked, "cls", "left").where("component is not null or copies > 1").withColumn("component", F.coalesce("component", "cls"))
    named = rows.groupBy("component").agg(F.min("id").alias("cluster_id"))
    return rows.join(named, "component").select(F.col("id").alias("doc_id"), "cluster_id", (F.col("id") == F.col("cluster_id")).alias("keep"))
