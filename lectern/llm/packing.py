"""Mixture-controlled packing of documents into token sequences.

Each source is a queue of its documents' tokens. Deficit round-robin fills every window of
CAPACITY tokens from the queues in proportion to their targets: in each window a queue earns
its quota, CAPACITY times its share, and sends as many whole tokens as it has earned; the
fraction is its deficit, which it carries into the next window. The tokens that queues 0..q send
in windows 0..k-1 together are the whole part of (k * CAPACITY * the share of queues 0..q), so
that every window is full and no deficit reaches one token. That sum can be worked out for any
window, so each task knows the deficits at its first document without a look at the others:
deficits carry over windows and partitions.

When a queue runs out, the others share out its part of that window and of those that follow.
Only the last window may be short. Queues with a quota below one token share a lane, one queue
after another. Targets default to the queues' own token counts: then every window has the
corpus's own mixture.

Two passes. The first tokenises, notes in each row its partition and its source's tokens before it
there, and writes the ids to the shared folder. What the sources have in each partition is added up.
Every source that earns a token a window, at most CAPACITY of them, and every source with a target
is a queue; the others share one queue, partition by partition. The second pass cuts each document
at the window borders. The sums are broadcast while they're at most MOST_SUMS, then no id shuffles;
beyond, Spark joins them as it sees fit, with the same result.

A null or empty text has the end mark as its only token. Rows without a source form a queue of their
own. Repeated rows are packed each for itself. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm.byte_bpe import byte_alphabet
from lectern.session import checkpoint_root, cut

CAPACITY = 4096
END = 2
MOST_PARTITIONS = 8192
#: Sums by source and partition that are broadcast: some 100 MB.
MOST_SUMS = 1 << 20


class WordTokenizer:
    """The ids of a tokenizers file whose words end with a mark, by byte-pair merges of whole texts at once.

    Every word is followed by one space, which no word holds and which stands for the mark; the file's
    ids are the ranks of the merges. Texts with characters that libraries lower, part or number
    differently go through the file itself, whole. Special tokens are those of the file.
    """

    #: Numbers that are no decimal digits, rare white space, and letters that newer tables have.
    ODD = "".join(c for c in map(chr, range(0x10000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha() or c.isspace() and c not in " \t\n\r")
    _odd = re.compile(f"[{ODD}\u1c89\u1c8a\ua7cb-\ua7dc\U00010000-\U0001efff\U0001f100-\U0001f10c]").search
    SIGNS = "\\0-\\x08\\x0e-\\x1b!-/:-@\\[-`{-\\xa9\\xab-\\xb4\\xb6-\\xb9\\xbb-\\xbf\\xd7\\xf7\\u2010-\\u2027\\u2030-\\u205e"
    # signs in a row, or a digit, are a word; contractions too. The second form is for alphabets beyond Latin.
    _wide = re.compile("[^\0-\u024f\u2010-\u2027\u2030-\u205e]").search
    _latin = re.compile(f"(?=[0-9{SIGNS}])(?:'(?:s|t|re|ve|m|ll|d)|[{SIGNS}]+|[0-9])").sub
    _any = re.compile(r"'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+|\d").sub

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            special = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        self.special = {x: np.array([i], "<u2").tobytes() for x, i in special.items()}
        self.parted = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        byte = {c: i for i, c in enumerate(byte_alphabet())}
        words = {x: i for x, i in self.model.get_vocab().items() if x not in special}
        ranks = {bytes(byte[c] for c in x.removesuffix("</w>")) + b" " * x.endswith("</w>"): i for x, i in words.items()}
        self.ids = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encode(self, text: str) -> bytes:
        low = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        if self._odd(low):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        low = (self._any if self._wide(low) else self._latin)(r" \g<0> ", low)
        return np.array(self.ids(low.replace("\n", " ").replace("\t", " ").replace("\r", " ") + " "), "<u2").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 16-bit integers."""
        if text and "<|" in text and self.parted:
            return b"".join(self.special.get(x) or self._encode(x) for x in self.parted(text) if x)
        return self._encode(text) if text else b""


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and file; the vocabulary has fewer than 65,536 ids."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


TOKENISED = "doc_id long, source string, part int, before long, n long, ids binary"


def tokenise(docs: DataFrame, path: str, batch: int = 200) -> DataFrame:
    """docs (doc_id, source, text) -> TOKENISED: ids with the end mark; before: the source's tokens ahead in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, sums = tokenizer(path).encode, TaskContext.get().partitionId(), {}
        end = np.array([END], "<u2").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                some = whole.slice(at, batch)
                ids = [encode(x) + end for x in some.column(2).to_pylist()]
                before = []
                for source, x in zip(some.column(1).to_pylist(), ids, strict=True):
                    before.append(sums.get(source, 0))
                    sums[source] = before[-1] + len(x) // 2
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([part] * n, pa.int32()), pa.array(before, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "source", "part", "before", "n", "ids"],
                )

    return docs.select("doc_id", "source", "text").coalesce(MOST_PARTITIONS).mapInArrow(run, TOKENISED)


class Plan:
    """Which tokens of which lane each window takes. totals: tokens by queue; targets: weights by queue."""

    def __init__(self, totals: dict[int, int], targets: dict[int, float] | None = None, capacity: int = CAPACITY):
        self.capacity = capacity
        totals = {q: n for q, n in sorted(totals.items()) if n > 0}
        share = {q: max(0, round((targets or {}).get(q, 0) * 1_000_000)) for q in totals} if targets else dict(totals)
        #: queue -> lane, and the tokens of the lane ahead of it
        self.lane: dict[int, tuple[int, int]] = {}
        self.lanes: list[list[int]] = self._merge(totals, share)
        left, weights = [], []
        for i, queues in enumerate(self.lanes):
            ahead = 0
            for q in queues:
                self.lane[q] = (i, ahead)
                ahead += totals[q]
            left.append(ahead)
            weights.append(sum(share[q] for q in queues))
        #: lane -> its stretches (first token, first window, windows or allotment, weight ahead, weight with it, all weights)
        self.stretches: list[list[tuple]] = [[] for _ in left]
        self._lay(left, weights)
        self.starts = [[x[0] for x in s] for s in self.stretches]

    def _merge(self, totals: dict[int, int], share: dict[int, int]) -> list[list[int]]:
        """Lanes of one queue each, but for queues that earn under one token a window, and for those without a target: they share one each."""
        whole = sum(share.values())
        order = sorted((q for q in totals if share[q]), key=lambda q: (share[q], q))
        last = [q for q in totals if not share[q]]
        lane, small = [], 0
        while order and (not lane or small * self.capacity < whole) and (lane or share[order[0]] * self.capacity < whole):
            lane.append(order.pop(0))
            small = sum(share[q] for q in lane)
        return [*([sorted(lane)] if lane else []), *([q] for q in sorted(order)), *([last] if last else [])]

    def _lay(self, left: list[int], weights: list[int]) -> None:
        done, window, cap = [0] * len(left), 0, self.capacity
        while sum(left) >= cap:
            active = [i for i, n in enumerate(left) if n]
            if not any(weights[i] for i in active):
                weights = list(left)  # only queues without a target are left: by what they have
            whole, ahead, marks = sum(weights[i] for i in active), 0, []
            for i in active:
                marks.append((i, ahead, ahead + weights[i]))
                ahead += weights[i]
            sent = lambda k, a, b: cap * k * b // whole - cap * k * a // whole
            low, high = 0, sum(left) // cap
            while low < high:  # the most windows that no lane falls short in
                mid = (low + high + 1) // 2
                low, high = (mid, high) if all(sent(mid, a, b) <= left[i] for i, a, b in marks) else (low, mid - 1)
            if low:
                for i, a, b in marks:
                    if b > a:
                        self.stretches[i].append((done[i], window, low, a, b, whole))
                    done[i] += sent(low, a, b)
                    left[i] -= sent(low, a, b)
                window += low
            if sum(left) >= cap:  # a lane runs out in this window: it sends what it has, the others make up for it
                takes = {i: min(left[i], sent(low + 1, a, b) - sent(low, a, b)) for i, a, b in marks}
                for i in sorted(takes, key=lambda i: -left[i]):
                    takes[i] += min(left[i] - takes[i], cap - sum(takes.values()))
                self._single(takes, done, left, window)
                window += 1
        if sum(left):
            self._single({i: n for i, n in enumerate(left) if n}, done, left, window)

    def _single(self, takes: dict[int, int], done: list[int], left: list[int], window: int) -> None:
        offset = 0
        for i, n in sorted(takes.items()):
            if n:
                self.stretches[i].append((done[i], window, None, offset, n, None))
                done[i] += n
                left[i] -= n
                offset += n

    def cut(self, queue: int, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, window, offset) of the pieces of a document with n tokens at a place of its queue."""
        lane, ahead = self.lane[queue]
        at += ahead
        first, stretches, cap = at, self.stretches[lane], self.capacity
        s = bisect_right(self.starts[lane], at) - 1
        while n:
            begin, window, windows, a, b, whole = stretches[s]
            inside = at - begin
            if windows is None:
                length = min(n, b - inside)
                yield at - first, length, window, a + inside
                at, n, s = at + length, n - length, s + (inside + length == b)
                continue
            k = inside * whole // (cap * (b - a))
            k = max(0, k - 2)
            below = lambda k: cap * k * b // whole - cap * k * a // whole
            while below(k + 1) <= inside:
                k += 1
            low = below(k)
            while n and k < windows:
                high = below(k + 1)
                length = min(n, high - inside)
                if length:
                    yield at - first, length, window + k, cap * (k + 1) * a // whole - cap * k * a // whole + inside - low
                at, n, inside = at + length, n - length, inside + length
                if inside == high:
                    k, low = k + 1, high
            s += k >= windows


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _key(source: str) -> str:
    """A source's name as it is kept in tables; rows without a source have the name -."""
    return f"+{source}"


def queues_of(sums: DataFrame, targets: dict[str, float] | None, capacity: int = CAPACITY) -> tuple[DataFrame, Plan]:
    """(source, part, queue, base): where a source's tokens of a partition begin in their queue; and the plan of the queues.

    sums: (source, part, n). The sources that earn a token a window are at most capacity.
    """
    named = {_key(k): v for k, v in (targets or {}).items()}
    totals = sums.groupBy("source").agg(F.sum("n").alias("n"))
    whole = sums.agg(F.sum("n")).first()[0] or 0
    large = totals.where((F.col("n") * capacity >= whole) | F.col("source").isin(*named)).orderBy("source").collect()
    number = {x["source"]: i for i, x in enumerate(large)}
    own = {i: x["n"] for i, x in enumerate(large)}
    rest = len(large)
    queues = sums.sparkSession.createDataFrame(list(number.items()), "source string, queue int")
    marked = sums.join(F.broadcast(queues), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(rest)))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = marked.where(F.col("queue") < rest).select("source", "part", "queue", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    shared = whole - sum(own.values())
    if shared:  # the others, partition by partition, in one by the source's name
        small = marked.where(F.col("queue") == rest)
        parts = small.groupBy("queue", "part").agg(F.sum("n").alias("n"))  # at most MOST_PARTITIONS rows
        before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
        inside = Window.partitionBy("part").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
        small = small.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part")
        bases = bases.unionByName(small.select("source", "part", "queue", (F.col("begin") + F.col("inside")).alias("base")))
    return bases, Plan(own | {rest: shared}, {number[k]: v for k, v in named.items() if k in number} if targets else None, capacity)


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", targets: dict[str, float] | None = None, with_ids: bool = False) -> DataFrame:
    """PIECES, one row for each piece of a document, with its ids (little-endian unsigned 32-bit) if asked for.

    path: a tokenizers file. targets: weights of sources; those not named come last. ids_crc32 is
    of the piece's ids.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("+"), F.col(source).cast("string")), F.lit("-"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), name.alias("source"), F.col(text).alias("text"))
    folder = f"{checkpoint_root(spark)}/packing-{uuid.uuid4().hex}"
    tokenise(rows, path).write.option("compression", "zstd").parquet(folder)
    tokens = spark.read.parquet(folder)
    sums = cut(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")))
    bases, plan = queues_of(sums, targets)
    if sums.count() <= MOST_SUMS:
        bases = F.broadcast(bases)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for doc, queue, base, before, n, packed in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                ids = np.frombuffer(packed, "<u2").astype("<u4").tobytes()
                for start, length, window, offset in plan.cut(queue, base + before, n):
                    piece = ids[4 * start : 4 * (start + length)]
                    row = (doc, start, length, zlib.crc32(piece), n, window, offset)
                    for column, value in zip(out, row + (piece,) * with_ids, strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=schema.names)

    schema = T.StructType.fromDDL(PIECES + ", ids binary" * with_ids)
    placed = tokens.join(bases, ["source", "part"])
    return placed.select("doc_id", "queue", "base", "before", "n", "ids").mapInArrow(cut_up, schema)
