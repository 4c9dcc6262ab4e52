"""Edit-aware token counts with a segment tree of pre-tokens for each document.

A document's pre-tokens are the leaves of a segment tree; a leaf has the pre-token's number of
code points and of tokens, an inner node the sums below it. Leaves are kept in slots of an array
of a power of two, so a tree is two arrays in heap order. An edit replaces code points start to
end of the text by others. Only the touched leaves, with the leaf before them as context, are cut
into pre-tokens again, and from there on until a new border meets an old one where what comes
before can't matter: the pattern looks ahead, and back over nothing, so the rest stays as it is.
The new leaves take the old slots while there's room, and the sums above them are renewed;
where there's none, the tree is laid out again from its leaves, which encodes nothing.

Trees are kept: tree_table gives each document's text with the lengths and token counts of its leaves,
kept_trees has them as a table, and recounted reads it, lays the sums out (which encodes nothing),
applies the edits that a column of the table has, and gives the new texts, trees and counts, so that
the result can be kept and edited again.

Edits of a document are applied from the last to the first, at offsets of the text as it was. If two
of a row overlap or one lies beyond the text, none of the row's edits is applied and refused is their
number. A null text counts as empty. Null or empty lists of edits leave the tree alone. Rows are
worked on one by one, repeated ones alike.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.byte_bpe import read_ranks
from lectern.session import checkpoint_root

#: Distinct pre-tokens whose count a worker remembers; it starts anew beyond.
CACHE_SIZE = 300_000
#: Code points that are looked at beyond an edit at first; doubled while borders don't meet.
CONTEXT = 64


class Counts(dict):
    """Pre-token -> number of tokens; fills itself."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        super().__init__()
        self.ranks = read_ranks(path)
        self.cut = regex.compile(pattern)
        self.model = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.asked = 0

    def __missing__(self, pretoken: str) -> int:
        n = 1 if pretoken.encode("utf-8", "surrogatepass") in self.ranks else len(self.model.encode_ordinary(pretoken))
        if len(self) >= CACHE_SIZE:
            self.clear()
        if len(pretoken) <= 64:
            self[pretoken] = n
        return n

    def of(self, pretokens: list[str]) -> list[int]:
        self.asked += len(pretokens)
        return list(map(self.__getitem__, pretokens))


@lru_cache(maxsize=2)
def counts(path: str, pattern: str) -> Counts:
    """One for each worker process and vocabulary."""
    return Counts(path, pattern)


class Tree:
    """Lengths and token counts of pre-tokens in heap order: node 1 is the root, node i has 2 i and 2 i + 1."""

    def __init__(self, lengths: list[int] | np.ndarray, tokens: list[int] | np.ndarray):
        self._lay(np.asarray(lengths, np.int64), np.asarray(tokens, np.int64))

    def _lay(self, lengths: np.ndarray, tokens: np.ndarray) -> None:
        self.size = 1 << max(0, int(len(lengths) * 5 // 4)).bit_length()
        self.nodes = np.zeros((2, 2 * self.size), np.int64)
        slots = np.arange(len(lengths)) * self.size // max(1, len(lengths))  # spread, so that edits find room
        self.nodes[0, self.size + slots], self.nodes[1, self.size + slots] = lengths, tokens
        level = self.size
        while level > 1:
            below = self.nodes[:, level : 2 * level]
            self.nodes[:, level // 2 : level] = below[:, ::2] + below[:, 1::2]
            level //= 2

    @property
    def length(self) -> int:
        return int(self.nodes[0, 1])

    @property
    def tokens(self) -> int:
        return int(self.nodes[1, 1])

    @property
    def leaves(self) -> int:
        return int(np.count_nonzero(self.nodes[0, self.size :]))

    def find(self, at: int) -> tuple[int, int]:
        """The slot of the leaf that has code point at, and where the leaf begins; the end of all if there's none."""
        if at >= self.length:
            return self.size, self.length
        node, begin = 1, 0
        while node < self.size:
            left = int(self.nodes[0, 2 * node])
            node, begin = (2 * node, begin) if at < begin + left else (2 * node + 1, begin + left)
        return node - self.size, begin

    def borders(self, slot: int, begin: int, until: int) -> list[int]:
        """Where leaves begin, from this one on, as far as until."""
        out = []
        while begin <= until and slot < self.size:
            n = int(self.nodes[0, self.size + slot])
            if n:
                out.append(begin)
                begin += n
            slot += 1
        return [*out, begin] if begin <= until else out

    def replace(self, first: int, last: int, lengths: list[int], tokens: list[int]) -> None:
        """New leaves in place of slots first to last (exclusive)."""
        if len(lengths) > last - first:
            a, b = self.size + first, self.size + last
            parts = [np.concatenate([row[self.size : a], new, row[b:]]) for row, new in zip(self.nodes, (lengths, tokens), strict=True)]
            used = parts[0] > 0
            self._lay(parts[0][used], parts[1][used])
            return
        low, high = self.size + first, self.size + last - 1
        self.nodes[:, low : high + 1] = 0
        self.nodes[0, low : low + len(lengths)], self.nodes[1, low : low + len(tokens)] = lengths, tokens
        while low > 1:  # the sums above
            low, high = low // 2, high // 2
            below = self.nodes[:, 2 * low : 2 * high + 2]
            self.nodes[:, low : high + 1] = below[:, ::2] + below[:, 1::2]


def build(text: str | None, by: Counts) -> Tree:
    pretokens = by.cut.findall(text or "")
    return Tree([len(p) for p in pretokens], by.of(pretokens))


def edit(tree: Tree, text: str, start: int, end: int, new: str, by: Counts) -> str:
    """Applies one edit to the tree; returns the new text."""
    if not 0 <= start <= end <= len(text):
        raise ValueError(f"no such part: {start} to {end} of {len(text)}")
    after, shift = text[:start] + new + text[end:], len(new) - (end - start)
    first, begin = tree.find(max(0, start - 1))  # the leaf before: the edit may lengthen it
    if begin > 0:
        first, begin = tree.find(begin - 1)  # and one more: it may end where the text looked otherwise
    slot, place = tree.find(end)
    reach = CONTEXT
    while True:
        stop = min(len(after), end + shift + reach)
        old = tree.borders(slot, place, stop - shift) if slot < tree.size else [tree.length]
        pretokens, at, meet = [], begin, None
        for m in by.cut.finditer(after, begin):
            if m.start() >= end + shift and _is_border(old, m.start() - shift) and m.start() - shift >= end:
                meet = m.start() - shift
                break
            if m.end() >= stop and stop < len(after):
                break
            pretokens.append(m[0])
            at = m.end()
        else:
            meet = tree.length if at == len(after) else None
        if meet is not None:
            break
        reach *= 4
    last = tree.find(meet)[0] if meet < tree.length else tree.size
    tree.replace(first, last, [len(p) for p in pretokens], by.of(pretokens))
    return after


def _is_border(borders: list[int], at: int) -> bool:
    i = bisect.bisect_left(borders, at)
    return i < len(borders) and borders[i] == at


def apply(tree: Tree, text: str | None, edits: list[tuple[int, int, str]], by: Counts) -> str:
    """Applies edits (start, end, new text) at offsets of the text as it was; returns the new text."""
    text, ahead = text or "", None
    for start, end, new in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
        if ahead is not None and end > ahead:
            raise ValueError("edits overlap")
        text, ahead = edit(tree, text, start, end, new, by), start
    return text


def pack(tree: Tree) -> bytes:
    """The leaves of a tree, lengths then token counts, as little-endian unsigned 32-bit integers."""
    leaves = tree.nodes[:, tree.size :]
    return leaves[:, leaves[0] > 0].astype("<u4").tobytes()


def unpack(leaves: bytes) -> Tree:
    lengths, tokens = np.frombuffer(leaves, "<u4").reshape(2, -1)
    return Tree(lengths, tokens)


#: Rows that are worked on at once.
ROWS = 256
TREES = "text string, leaves binary, n_chars long, n_pretokens long, n_tokens long"
COUNTED = "text string, leaves binary, n_chars long, n_pretokens long, n_tokens long, n_edits long, refused long, edited_chars long, edited_pretokens long, edited_tokens long, recounted_pretokens long"


def _mapped(rows: DataFrame, work: Callable[..., tuple], path: str, pattern: str, schema: str) -> DataFrame:
    """rows, doc_id first; work gives the columns of schema from the others' values and the counts of pre-tokens."""
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]
    kinds = [{"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = counts(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                some = whole.slice(at, ROWS)
                columns = zip(*(work(by, *values) for values in zip(*(c.to_pylist() for c in some.columns[1:]), strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def tree_table(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, TREES), one row for each row of docs."""

    def work(by: Counts, words: str | None) -> tuple:
        pretokens = by.cut.findall(words or "")
        leaves = np.array([list(map(len, pretokens)), by.of(pretokens)], "<u4")
        return words, leaves.tobytes(), len(words or ""), len(pretokens), int(leaves[1].sum())

    return _mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), work, path, pattern, TREES)


def kept_trees(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """tree_table as a table in folder, by default a new one in the shared folder."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_root(spark)}/trees-{uuid.uuid4().hex}"
    tree_table(docs, path, pattern, doc_id, text).write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def recounted(trees: DataFrame, path: str, pattern: str, edits: str = "edits") -> DataFrame:
    """(doc_id, COUNTED): text, leaves and counts after the edits, array<struct<start,end,new>>, and the counts before.

    trees: (doc_id, text, leaves) with the column of edits. recounted_pretokens: how many were encoded again.
    """

    def work(by: Counts, text: str | None, leaves: bytes, changes: list[dict] | None) -> tuple:
        lengths, tokens = np.frombuffer(leaves, "<u4").reshape(2, -1)
        before = after = int(lengths.sum()), len(lengths), int(tokens.sum())
        wanted = sorted((e["start"], e["end"], e["new"] or "") for e in changes or ())
        refused = any(a[1] > b[0] for a, b in zip(wanted, wanted[1:])) or any(not 0 <= a <= b <= before[0] for a, b, _ in wanted)
        asked = by.asked
        if wanted and not refused:  # only then are the sums laid out
            tree = unpack(leaves)
            text = apply(tree, text, wanted, by)
            leaves, after = pack(tree), (tree.length, tree.leaves, tree.tokens)
        return text, leaves, *before, len(wanted) * (not refused), len(wanted) * refused, *after, by.asked - asked

    return _mapped(trees.select("doc_id", "text", "leaves", F.col(edits).alias("edits")), work, path, pattern, COUNTED)
