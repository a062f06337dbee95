"""Byte-level BPE through a sentencepiece model that is serialised straight from a vocabulary of ranks.

Each byte is written as one character (``chr(OFFSET + byte)``), so a piece of the vocabulary becomes a string of such
characters, scored by its negative rank; the normaliser is the identity. sentencepiece then merges the adjacent pair
of the highest score, leftmost first, which is the pair of the lowest rank. A pre-token that is itself in the
vocabulary is that one id. Decoding maps ids back to their bytes.

Defined results: null text counts as empty, an empty text has no ids (both digests are of nothing); repeated rows give
repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lattica.llm.common import in_small_batches

#: Code point that stands for byte 0; the block that follows has 256 letters without white space.
OFFSET = 0x100
#: Pre-tokens whose ids a worker keeps at once.
CACHE = 200_000
#: Rows that are encoded before they are handed on.
ROWS = 512


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = b""
    n &= (1 << 64) - 1
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: int | bytes | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def mapped(data: bytes) -> str:
    return "".join(chr(OFFSET + b) for b in data)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces by rank, then the unknown piece; BPE; no normalisation."""
    out = [_field(1, _field(1, mapped(token).encode()) + _field(2, float(-rank)) + _field(3, 1)) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    n = len(ranks)
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Codec(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers; unseen ones are encoded on demand."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        super().__init__()
        self.ranks, self.rx = ranks, regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        ordered = sorted(ranks.items(), key=lambda x: x[1])
        self.rank_of_piece = np.array([r for _, r in ordered] or [0], dtype="<u4")
        self.token_of = {r: t for t, r in ordered}
        self.letters = str.maketrans({b: chr(OFFSET + b) for b in range(256)})

    def __missing__(self, pre: str) -> bytes:
        raw = pre.encode()
        if (whole := self.ranks.get(raw)) is not None:
            ids = struct.pack("<I", whole)
        else:
            ids = self.rank_of_piece[self.model.encode(raw.decode("latin-1").translate(self.letters))].tobytes()
        if len(self) >= CACHE:
            self.clear()
        if len(pre) < 200:
            self[pre] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.rx.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary in a worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """Of each document: doc_id, n_tokens, the two digests and, if asked for, ids (array of int) and the decoded text.

    No shuffle: each batch of rows is encoded where it is read."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        # Few rows at once: what a worker holds beside the batch is bounded by them.
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            n, digests, decoded, all_ids, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                own = c.encode(text or "")
                back = c.decode(own)
                n.append(len(own) // 4)
                digests.append(hashlib.sha256(own).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                if ids:
                    all_ids.append(np.frombuffer(own, dtype="<i4"))
                    texts.append(back.decode())
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if ids:
                columns |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
