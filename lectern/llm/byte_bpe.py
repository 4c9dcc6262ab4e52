"""Byte-level BPE encoding and decoding through a sentencepiece model built from the vocabulary.

The vocabulary (token bytes -> rank) is serialised as a sentencepiece BPE model: every byte
string is written with one printable character for each byte, its score is the negative
rank, and normalisation is the identity. Text is cut into pre-tokens by the tokenizer's
pattern, each distinct pre-token is encoded on its own, and ids are decoded by the inverse
mapping. Tokenizer files stay where they are: their path is a parameter.

Null texts count as empty and give no ids. Texts of any length are encoded whole. A column
of the input that has the name of an output column is replaced by it.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct pre-tokens that a worker remembers; it starts anew beyond.
CACHE_SIZE = 150_000
#: Code points from which on a text's pre-tokens aren't held all at once.
LONG = 1 << 18


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself if printable in Latin-1, else from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto of a byte-level vocabulary; a piece's id is its token's rank.

    Ranks must be 0..n-1; the unknown piece, which no byte string needs, gets id n.
    """
    alphabet = byte_alphabet()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks are not 0..n-1")
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(alphabet[b] for b in token).encode()
        out += _block(1, _block(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _number(3, 1))
    out += _block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))
    # trainer: model type BPE, vocabulary size, no white-space rules, unknown id; no begin, end or padding id
    none = (1 << 64) - 1
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(22, 0) + _number(40, len(tokens))
    trainer += _number(41, none) + _number(42, none) + _number(43, none)
    out += _block(2, trainer)
    # normaliser: identity, no dummy prefix, white space kept and not escaped
    out += _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Encoder(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers; fills itself."""

    def __init__(self, path: str, pattern: str, cache_size: int = CACHE_SIZE):
        import regex
        import sentencepiece

        super().__init__()
        ranks = read_ranks(path)
        self.cut = regex.compile(pattern)
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.known = {token: struct.pack("<I", rank) for token, rank in ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.table = dict(enumerate(byte_alphabet()))
        self.cache_size = cache_size

    def __missing__(self, pretoken: str) -> bytes:
        raw = pretoken.encode("utf-8", "surrogatepass")
        ids = self.known.get(raw)
        if ids is None:
            found = self.model.encode(raw.decode("latin-1").translate(self.table))
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(self) >= self.cache_size:
            self.clear()
        if len(raw) <= 64:
            self[pretoken] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Of a long text, pre-tokens are held some at a time."""
        if not text:
            return b""
        if len(text) <= LONG:
            return b"".join(map(self.__getitem__, self.cut.findall(text)))
        found = (m[0] for m in self.cut.finditer(text))
        return b"".join(iter(lambda: b"".join(map(self.__getitem__, islice(found, LONG))), b""))

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I"))) if ids else b""


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process and vocabulary."""
    return Encoder(path, pattern)


#: Rows that are worked on at once.
ROWS = 128
ENCODED = "ids binary, n_tokens long, decoded binary"


def encode_documents(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ids (packed little-endian unsigned 32-bit integers), n_tokens and decoded (the ids' bytes) to every row of df.

    One Arrow stage encodes and decodes, ROWS rows at a time; select the columns that are needed first.
    """
    names = [x.split()[0] for x in ENCODED.split(", ")]
    kept = [c for c in df.columns if c not in names]
    rows = df.select(F.col(text).alias("_encode"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                some = whole.slice(at, ROWS)
                ids = [by.encode(t) for t in some.column(0).to_pylist()]
                added = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([by.decode(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays([*some.columns[1:], *added], names=[*kept, *names])

    schema = T.StructType([*(f for f in rows.schema.fields[1:]), *T.StructType.fromDDL(ENCODED)])
    return rows.mapInArrow(run, schema)
