"""Encoding of texts by a public byte-level BPE vocabulary, as a sentencepiece model made from the vocabulary itself."""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, types as T

#: Folder of the public vocabularies.
VOCABULARIES = "/opt/tokenizers"
#: Pre-tokens that a worker remembers, which bounds its memory.
MEMO = 300_000

# Unicode's White_Space, and the public pre-token pattern of byte-level BPE over it.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
# The same over ASCII, frequent alternatives first: they begin with other characters than the contractions.
_ASCII = r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def byte_letters() -> list[str]:
    """A letter for each byte: visible Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


_TO_LETTER = dict(enumerate(byte_letters()))
_TO_BYTE = {ord(letter): byte for byte, letter in _TO_LETTER.items()}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token and rank per line), by rank; ranks must be 0 to n-1."""
    by_rank = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())}
    if sorted(by_rank) != list(range(len(by_rank))):
        raise ValueError(f"{path}: the ranks are not 0 to n-1")
    return [by_rank[i] for i in range(len(by_rank))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the tokens' ranks.

    A piece is its token in :func:`byte_letters`; its score is the negative rank, so that pairs merge in the order of ranks; the
    normaliser changes nothing and adds nothing. The unknown piece that a model needs comes last and never occurs, as each byte
    is a token.
    """
    if missing := [b for b in range(256) if bytes([b]) not in set(tokens)]:
        raise ValueError(f"bytes without a token: {missing[:5]}")
    normal, unknown = 1, 2
    piece = lambda text, score, kind: _block(1, _block(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))
    pieces = [piece(token.decode("latin-1").translate(_TO_LETTER), -float(rank), normal) for rank, token in enumerate(tokens)]
    pieces.append(piece("", 0.0, unknown))
    bpe = 2
    trainer = _number(3, bpe) + _number(4, len(pieces)) + _number(40, len(tokens)) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normalizer)


class Codec:
    """Encodes and decodes with a model of :func:`sentencepiece_model`."""

    def __init__(self, model: bytes) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        processor, letters = self.processor, _TO_LETTER

        class Memo(dict):
            def __missing__(self, token: str) -> tuple[int, ...]:
                ids = tuple(processor.encode(token.encode().decode("latin-1").translate(letters)))
                if len(self) >= MEMO:
                    self.clear()
                self[token] = ids
                return ids

        self.memo = Memo()
        self.ascii, self.any = re.compile(_ASCII).findall, regex.compile(_PATTERN).findall

    def encode(self, text: str | None) -> Iterator[int]:
        """The ids of a text, pre-token by pre-token; none for an empty or null text."""
        if not text:
            return iter(())
        tokens = self.ascii(text) if text.isascii() else self.any(text)
        return chain.from_iterable(map(self.memo.__getitem__, tokens))

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        letters = "".join(map(self.processor.id_to_piece, ids))
        return bytes(_TO_BYTE[ord(c)] for c in letters).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def encode_texts(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``key`` and ``ids`` (ARRAY<INT>) of each row: the ids of its whole text, without special tokens.

    The spelling of a special token in a text is ordinary text. An empty and a null text have an empty list; the row of a null key
    is kept. Rows, repeated ones too, map one to one, without a shuffle; other columns are left out. The vocabulary's file is
    read once, by the driver; its model (about 1 MB, bounded by the vocabulary) is broadcast.
    """
    spark = texts.sparkSession
    model = spark.sparkContext.broadcast(sentencepiece_model(read_ranks(f"{folder}/{vocabulary}.tiktoken")))
    name = hash((vocabulary, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _codecs:
            _codecs[name] = Codec(model.value)
        encode = _codecs[name].encode
        for batch in batches:
            flat, offsets = array("i"), array("i", [0])
            for value in batch.column(1).to_pylist():
                flat.extend(encode(value))
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(memoryview(flat), pa.int32()) if len(flat) else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "ids"])

    narrow = texts.select(texts[key].alias(key), texts[text].alias("text"))
    schema = T.StructType([T.StructField(key, narrow.schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return narrow.mapInArrow(run, schema)
