"""Evaluation items in training texts: a BM25 index of the items, asked with every passage by block-max WAND."""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lodestrata.plans.lineage import cut

#: BM25's usual parameters.
K1, B = 1.2, 0.75
#: Items per block, whose weights are bounded together.
BLOCK = 8
#: Words of the items of one index (some 50 MB), and indexes that one scan of the texts asks.
INDEX_WORDS, INDEXES_PER_SCAN = 2_000_000, 4
#: Numbers that a step holds at once.
CELLS = 4_000_000
#: Sums of 32-bit weights may fall short of the exact sum by this.
SLACK = 1e-4

words_of = re.compile("[a-z0-9]+").findall
_SPACED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def words(text: str | None) -> list[str]:
    """The maximal runs of a-z and 0-9 after lower-casing; none of a null text."""
    return words_of(text.lower()) if text else []


def byte_words(text: str | None) -> list[bytes]:
    """:func:`words` as bytes, faster: what isn't ASCII becomes a question mark, which separates like all else."""
    return text.lower().encode("ascii", "replace").translate(_SPACED).split() if text else []


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``first[k], first[k] + 1, ...``, ``size[k]`` numbers each, and the k of each."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - (np.cumsum(size) - size)[of] + first[of], of


def _chunks(n: int, width: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, width))
    for k in range(0, n, step):
        yield slice(k, min(n, k + step))


class ItemIndex:
    """An inverted index of items for one question: which items can share ``run`` consecutive words with a passage?

    A word's BM25 weight in an item is divided by the item's threshold: the least score that a passage holding one of the item's
    word runs can have. So 1 is the threshold of every item, and retrieving all items that reach it loses none.

    A run's pivot is its rarest pair of neighbouring words, of equally rare ones the pair met first (its word, if it is one word). A passage that
    holds the run has the same pivot, so that only the postings of a passage's pivot are walked, and these list an item under the pivots
    of its runs only: the shortest lists of the passage, whatever the number of items.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], run: int) -> None:
        spelled: dict[bytes, int] = {}
        coded = [np.array([spelled.setdefault(w, len(spelled)) for w in ws], np.int64) for _, ws in items]
        df = np.bincount(np.concatenate([np.unique(c) for c in coded]), minlength=len(spelled))
        self.vocabulary, self.n_words = spelled, len(df) + 1  # the last word is any unknown one
        # Similar items, by their rarest word, stand next to one another, so that a block's bound is near its items' weights.
        order = sorted(range(len(items)), key=lambda k: (min(zip(df[coded[k]].tolist(), coded[k].tolist())), items[k][0]))
        self.ids, coded = [items[k][0] for k in order], [coded[k] for k in order]
        size = np.array([len(c) for c in coded])
        self.flat, self.starts = np.concatenate(coded).astype(np.int32), np.cumsum(size) - size
        self.ends, self.need = self.starts + size, np.minimum(run, size)
        self.n_blocks = -(-len(items) // BLOCK)
        # Weights by word and item.
        of = np.repeat(np.arange(len(items)), size)
        keys, place, tf = np.unique(self.flat * np.int64(len(items)) + of, return_inverse=True, return_counts=True)
        word, item = keys // len(items), keys % len(items)
        idf = np.log(1 + (len(items) - df + 0.5) / (df + 0.5))
        weight = idf[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / size.mean()))
        # Pairs of neighbours within an item, from the rarest on, and a table of bits that most other pairs fail.
        inside = np.append(of[1:] == of[:-1], False)
        codes = np.append(self.flat[:-1] * np.int64(self.n_words) + self.flat[1:], 0)
        self.pairs, pair_of, n_of = np.unique(codes[inside], return_inverse=True, return_counts=True)
        self.rank = np.argsort(np.lexsort((np.arange(len(n_of)), n_of))).astype(np.int32)
        self.bits = np.zeros(1 << max(10, int(8 * len(self.pairs)).bit_length()), bool)
        self.bits[self._bit(self.pairs)] = True
        pair = np.full(len(self.flat), -1)
        pair[inside] = pair_of
        least, postings = self._runs(weight[place], of, pair)
        self.keys, self.weights = keys, (weight / least[item]).astype(np.float32)
        blocks, first = np.unique(word * self.n_blocks + item // BLOCK, return_index=True)
        self.block_keys, self.most = blocks, np.maximum.reduceat(self.weights, first)
        # The largest weight of a word among items of each size of run, and their postings by pivot: a pair, or a word for runs of one.
        self.sizes = np.unique(self.need).tolist()
        self.bound = {n: np.zeros(len(df) + 1, np.float32) for n in self.sizes}
        self.slot, self.list_starts, self.list_items = {}, {}, {}
        for n in self.sizes:
            mine = self.need[item] == n
            np.maximum.at(self.bound[n], word[mine], self.weights[mine])
            pivots, first = np.unique(postings[n] // len(items), return_index=True)
            self.slot[n] = np.full(self.n_words if n == 1 else len(self.pairs), -1, np.int32)
            self.slot[n][pivots] = np.arange(len(pivots))
            self.list_starts[n] = np.append(first, len(postings[n]))
            self.list_items[n] = (postings[n] % len(items)).astype(np.int32)

    def _bit(self, codes: np.ndarray) -> np.ndarray:
        """The bit of each pair: the upper bits of a product."""
        with np.errstate(over="ignore"):
            return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.bits).bit_length())).astype(np.int64)

    def pairs_of(self, ids: np.ndarray) -> np.ndarray:
        """The pair that begins at each place, -1 where the items don't have it."""
        out = np.full(len(ids), -1, np.int64)
        if len(self.pairs):
            codes = ids[:-1] * np.int64(self.n_words) + ids[1:]
            maybe = np.flatnonzero(self.bits[self._bit(codes)])
            at = np.minimum(np.searchsorted(self.pairs, codes[maybe]), len(self.pairs) - 1)
            same = self.pairs[at] == codes[maybe]
            out[maybe[same]] = at[same]
        return out

    def _runs(self, weight: np.ndarray, of: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Each item's threshold, and per size of run the sorted ``pivot * items + item``. ``weight``, ``of`` and ``pair`` are by place in ``flat``."""
        flat, n_items = self.flat, len(self.ids)
        # A word counts once in a run: where it didn't stand before within it.
        by = np.lexsort((np.arange(len(flat)), flat, of))
        before = np.full(len(flat), -1)
        same = (flat[by][1:] == flat[by][:-1]) & (of[by][1:] == of[by][:-1])
        before[by[1:][same]] = by[:-1][same]
        least, postings = np.full(n_items, np.inf), {}
        for n in np.unique(self.need).tolist():
            mine = np.flatnonzero(self.need == n)
            starts, owner = _spread(self.starts[mine], self.ends[mine] - self.starts[mine] - n + 1)
            pivots = np.empty(len(starts), np.int64)
            for part in _chunks(len(starts), n):
                at = starts[part, None] + np.arange(n)
                np.minimum.at(least, mine[owner[part]], (weight[at] * (before[at] < starts[part, None])).sum(1))
                pivots[part] = flat[starts[part]] if n == 1 else pair[starts[part] + self.rank[pair[at[:, :-1]]].argmin(1)]
            postings[n] = np.unique(pivots * n_items + mine[owner])
        return least, postings

    def passages(self, ids: np.ndarray, pair: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and pivots (places) of the passages for runs of ``n`` words: neighbouring windows that have the pivot in common.

        A word, or a pair of neighbours, that no item has breaks every run, so that no window holds one; no passage is longer than
        2n - 1 words.
        """
        if len(ids) < n:
            return (np.zeros(0, np.int64),) * 3
        count = lambda known: np.concatenate([[0], np.cumsum(known)])
        words, pairs = count(self.bound[n][ids] > 0), count(pair >= 0)
        starts = np.flatnonzero((words[n:] - words[:-n] == n) & (pairs[n - 1 : len(pairs) - 1] - pairs[: len(pairs) - n] == n - 1))
        if not len(starts):
            return starts, starts, starts
        pivots = starts.copy()
        for part in _chunks(len(starts), n) if n > 1 else ():
            pivots[part] += self.rank[pair[starts[part, None] + np.arange(n - 1)]].argmin(1)
        new = np.ones(len(starts), bool)
        new[1:] = (pivots[1:] != pivots[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        return starts[first], starts[np.append(first[1:], len(starts)) - 1] + n, pivots[first]

    def _look(self, keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], np.float32(0))

    def retrieve(self, ids: np.ndarray, pair: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All (pivot's place, item, score) that reach the items' thresholds, of items with runs of ``n`` words.

        A passage is dropped if even the largest weights of its words stay below the threshold, or its pivot is no item's. Then the
        pivot's postings are walked: a block is skipped if the largest weights within it stay below, and its items are scored else.
        """
        starts, ends, pivots = self.passages(ids, pair, n)
        key = ids if n == 1 else pair
        keep = self.slot[n][key[pivots]] >= 0
        starts, ends, pivots = starts[keep], ends[keep], pivots[keep]
        for part in _chunks(len(starts), 64 * n):
            s, e, p = starts[part], ends[part], pivots[part]
            at, owner = _spread(s, e - s)
            once = np.unique(owner * np.int64(self.n_words) + ids[at])  # each word of a passage once
            owner, word = once // self.n_words, once % self.n_words
            reach = np.bincount(owner, self.bound[n][word], minlength=len(s))
            first, size = np.searchsorted(owner, np.arange(len(s))), np.bincount(owner, minlength=len(s))
            asked = np.flatnonzero(reach >= 1 - SLACK)
            slot = self.slot[n][key[p[asked]]]
            where, k = _spread(self.list_starts[n][slot], self.list_starts[n][slot + 1] - self.list_starts[n][slot])
            passage, item = asked[k], self.list_items[n][where]
            for some in _chunks(len(item), 2 * n):
                q, i = passage[some], item[some].astype(np.int64)
                blocks, back = np.unique(q * np.int64(self.n_blocks) + i // BLOCK, return_inverse=True)
                bound = self._sums(self.block_keys, self.most, self.n_blocks, blocks // self.n_blocks, blocks % self.n_blocks, first, size, word)
                fit = bound[back] >= 1 - SLACK
                q, i = q[fit], i[fit]
                score = self._sums(self.keys, self.weights, len(self.ids), q, i, first, size, word)
                hit = score >= 1 - SLACK
                yield p[q[hit]], i[hit], score[hit]

    def _sums(self, keys, values, width: int, passage, column, first, size, word) -> np.ndarray:
        """The sum of the passages' words in a column (a block or an item) of a sparse table by word and column."""
        at, of = _spread(first[passage], size[passage])
        return np.bincount(of, self._look(keys, values, word[at] * np.int64(width) + column[of]), minlength=len(passage))

    def verify(self, ids: np.ndarray, place: int, item: int) -> int:
        """Words of the longest run through ``place`` that text and item share, if it is as long as needed, else 0."""
        theirs, best = self.flat[self.starts[item] : self.ends[item]], 0
        same = theirs == ids[place]
        if self.need[item] > 1:  # the pivot is a pair
            same[:-1] &= theirs[1:] == ids[place + 1]
            same[-1] = False
        for at in np.flatnonzero(same).tolist():
            same = ids[place : place + len(theirs) - at] == theirs[at : at + len(ids) - place]
            after = len(same) if same.all() else int(same.argmin())
            back = min(place, at)
            same = ids[place - back : place][::-1] == theirs[at - back : at][::-1]
            best = max(best, after + (back if same.all() else int(same.argmin())))
        return best if best >= self.need[item] else 0

    def leaks(self, texts: list[list[bytes]]) -> dict[tuple[int, int], tuple[int, float]]:
        """``(text, item id)`` to the longest shared run and the best score."""
        get, unknown = self.vocabulary.get, len(self.vocabulary)
        coded = [k for ws in texts for k in (*map(get, ws, repeat(unknown)), unknown)]
        ids, text_of = np.array(coded, np.int64), np.cumsum([len(ws) + 1 for ws in texts])
        found: dict[tuple[int, int], tuple[int, float]] = {}
        pair, whole = self.pairs_of(ids), (self.ends - self.starts).tolist()
        for n in self.sizes:
            for places, items, scores in self.retrieve(ids, pair, n):
                of = np.searchsorted(text_of, places, "right")
                for p, item, score, text in zip(places.tolist(), items.tolist(), scores.tolist(), of.tolist()):
                    was = found.get((text, self.ids[item]), (0, 0.0))
                    if was[0] >= whole[item] and score <= was[1]:
                        continue  # as in a text that repeats an item
                    if length := self.verify(ids, p, item):
                        found[text, self.ids[item]] = (max(was[0], length), max(was[1], score))
        return found


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", run: int = 13) -> DataFrame:
    """``key, item_id, run_words, score`` of each document and each item of which it holds ``run`` consecutive words.

    Of an item with fewer words it must hold all, likewise consecutive; items without words have no cases. ``run_words`` is the length
    of the longest run of words that both share, ``score`` the best passage's BM25 score as a multiple of the item's threshold. Words
    are the maximal runs of a-z and 0-9 of the whole lower-cased text; null texts have none. Rows without key or item are
    ignored, repeated keys and items give one row each, other columns are ignored, and empty tables give no rows.

    Tasks build indexes of about INDEX_WORDS words of items each, which pass the driver one by one, as bytes, to be broadcast. One scan of
    the documents, which aren't shuffled, asks INDEXES_PER_SCAN of them; only more items than these hold need another scan.
    """
    if run < 1:
        raise ValueError("a run has one word at least")
    narrow = documents.select(documents[key].alias(key), documents[text].alias("text")).where(f"`{key}` is not null and text is not null")
    schema = T.StructType([T.StructField(key, narrow.schema[0].dataType), T.StructField("item_id", T.LongType()), T.StructField("run_words", T.IntegerType()), T.StructField("score", T.DoubleType())])
    spark = documents.sparkSession
    listed = items.select(items[item].cast("long").alias("item"), items[item_text].alias("text")).where("item is not null and text is not null").distinct()
    total = listed.agg(F.sum(F.regexp_count(F.lower("text"), F.lit("[a-z0-9]+")))).first()[0] or 0
    portion = F.pmod(F.xxhash64("item", "text"), F.lit(math.ceil(total / INDEX_WORDS) or 1)).alias("portion")

    def build(part: pa.Table) -> pa.Table:
        rows = [(i, ws) for i, t in zip(part.column("item").to_pylist(), part.column("text").to_pylist()) if (ws := byte_words(t))]
        blobs = [pickle.dumps(ItemIndex(rows, run), pickle.HIGHEST_PROTOCOL)] if rows else []
        return pa.table({"blob": pa.array(blobs, pa.binary())})

    indexes = cut(listed.select(portion, "item", "text").groupBy("portion").applyInArrow(build, "blob binary"))

    def one_scan(blobs: list[bytes]) -> DataFrame:
        shared = [spark.sparkContext.broadcast(blob) for blob in blobs]

        def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = [pickle.loads(b.value) for b in shared]
            for batch in batches:
                texts = [byte_words(t) for t in batch.column(1).to_pylist()]
                rows = [(k, i, n, score) for index in asked for (k, i), (n, score) in index.leaks(texts).items()]
                keys = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.float64())], schema.names)

        return narrow.mapInArrow(run_batches, schema)

    scans, part = [], []
    for row in indexes.toLocalIterator():
        part.append(bytes(row["blob"]))
        if len(part) == INDEXES_PER_SCAN:
            scans.append(one_scan(part))
            part = []
    if part:
        scans.append(one_scan(part))
    if not scans:
        return spark.createDataFrame([], schema)
    out = scans[0]
    for more in scans[1:]:
        out = out.unionByName(more)
    return out.groupBy(key, "item_id").agg(F.max("run_words").alias("run_words"), F.max("score").alias("score"))
