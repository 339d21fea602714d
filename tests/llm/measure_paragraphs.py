"""python tests/llm/measure_paragraphs.py [DIR]: how many of the pairs that share 300 characters paragraph MinHash banding finds.

Paragraphs (between empty lines, and single lines too) are sets of five-word shingles; 128 hashes in 32 bands of 4 bring together paragraphs, exact Jaccard
of 0.8 or more links their documents. The truth is the exact search of ``p9_found`` in its SQL form.
"""

import itertools
import re
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from lodestrata.llm.queries import REGISTRY  # noqa: E402
from tools.compare import duck  # noqa: E402

BANDS, ROWS, LEAST = 32, 4, 0.8


def pairs_by_paragraphs(documents, split):
    texts, where = {}, defaultdict(set)
    for doc, text in documents:
        for part in re.split(split, text):
            if ws := part.split():
                shingles = frozenset(" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4)))
                where[texts.setdefault(shingles, len(texts))].add(doc)
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 2**61 - 1, BANDS * ROWS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**61 - 1, BANDS * ROWS, dtype=np.uint64)
    buckets = defaultdict(list)
    for shingles, k in texts.items():
        h = np.array([hash(s) & 0xFFFFFFFF for s in shingles], np.uint64)
        least = ((h[:, None] * a + b) >> np.uint64(7)).min(0).reshape(BANDS, ROWS)
        for band in range(BANDS):
            buckets[band, least[band].tobytes()].append(k)
    sets, linked = list(texts), set()
    for group in buckets.values():
        for i, j in itertools.combinations(group, 2):
            if len(sets[i] & sets[j]) >= LEAST * len(sets[i] | sets[j]):
                linked.add((i, j))
    out = {p for docs in where.values() for p in itertools.combinations(sorted(docs), 2)}
    for i, j in linked:
        out |= {(min(x, y), max(x, y)) for x in where[i] for y in where[j] if x != y}
    return out


def main():
    con = duck(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
    truth = {tuple(r) for r in con.execute(REGISTRY.sql["p9_found"]).fetchall()}
    documents = con.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall()
    for name, split in (("paragraphs", r"\n\s*\n"), ("lines", r"[\r\n]+")):
        found = pairs_by_paragraphs(documents, split)
        print(f"{name}: {len(found)} pairs, {len(found & truth)} of {len(truth)} true ones: recall {len(found & truth) / len(truth):.3f}, precision {len(found & truth) / max(1, len(found)):.3f}", flush=True)


if __name__ == "__main__":
    main()
