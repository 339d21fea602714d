import base64
import random
from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st

from lodestrata.llm.tokenizer import VOCABULARIES, Codec, byte_letters, encode_texts, read_ranks, sentencepiece_model

RANKS = f"{VOCABULARIES}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not Path(RANKS).exists(), reason="the vocabularies aren't here")


@pytest.fixture(scope="module")
def codec():
    return Codec(sentencepiece_model(read_ranks(RANKS)))


@pytest.fixture(scope="module")
def theirs():
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(read_ranks(RANKS))}, special_tokens={})


TEXTS = ["", " ", "a", "don't I'LL we've", "\n\n  x\t\ty  ", "naïve Ünïcode – größer", "版本 ключ 記録", "<|endoftext|>", "🙂🙃 👩‍👩‍👧", "\x00\x1c\x1f\x85  ​", "a" * 5000, " " * 3000 + "x", "0123456789" * 50, "½ Ⅷ ²", "é"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_ranks(codec, theirs, text):
    ids = list(codec.encode(text))
    assert ids == theirs.encode_ordinary(text) and codec.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_text(codec, theirs, text):
    ids = list(codec.encode(text))
    assert codec.decode(ids) == text
    assert ids == theirs.encode_ordinary(text)


def test_letters_and_ranks(tmp_path):
    assert len(set(byte_letters())) == 256
    bad = tmp_path / "bad.tiktoken"
    bad.write_bytes(base64.b64encode(b"a") + b" 1\n")
    with pytest.raises(ValueError):
        read_ranks(str(bad))
    with pytest.raises(ValueError):
        sentencepiece_model([b"a"])


def test_table(spark, codec):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", *TEXTS]), i, [i]) for i in range(60)] + [(None, "x", 0, [0]), (3, "again", 1, [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, key array<int>")
    got = sorted(((r.doc_id, list(r.ids)) for r in encode_texts(df).collect()), key=repr)
    assert got == sorted(((d, list(codec.encode(t))) for d, t, *_ in rows), key=repr)
    assert encode_texts(df.limit(0)).collect() == [] and encode_texts(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
