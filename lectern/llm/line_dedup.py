"""Fuzzy line duplicates by MinHash, one line of each component stays.

A line's shingles are its runs of SHINGLE characters, or the whole line if it is shorter. Its
signature has BINS bins: a shingle's hash tells its bin, and the smallest of a bin counts
(one-permutation MinHash); an empty bin takes the value of another one, which its number alone
chooses. BANDS bands of ROWS values each, from bins that are chosen likewise, give the candidate
keys: two lines with a Jaccard similarity of 0.8 share one of them with a probability of 0.992,
of 0.85 with one of 0.999.

Signatures, the search for keys that lines share, bit maps and the exact comparison run in numpy and Python within
Arrow batches: with DataFrame functions only they needed more than their budget (see the README). The rest are DataFrame operations.

Only keys that two different lines have go on. Every two lines of a key are candidates, unless their
sketches (a bit for each bin) differ in more than FAR
places, their bit maps of all shingles (of keys of many lines; an exact bound, see near_copies) in more than the
similarity allows, or other links join them already; see links_within_buckets. At a similarity of 0.8 sketches
differ in about six places, unlike lines' in 32. Each candidate is compared by the exact Jaccard
similarity of the shingle sets; matches are links, and components come from distributed star contraction.

The first occurrence of a component stays: by id (null last), then place. Blank lines are no
duplicates and always stay. A null text counts as one blank line. Rows that repeat an id and its
text have the same places: each of them is marked alike. Columns other than id and text aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import connected_components, join_by_hot_key, links_within_buckets, one_of_each, sieved, with_texts
from lectern.llm.near_copies import bit_map, may_equal
from lectern.session import cut

SHINGLE, SIMILARITY = 5, 0.8
BINS, ROWS, BANDS = 64, 5, 12
#: Sketches of lines with at least LEAST shingles are looked at.
FAR, LEAST = 20, 24
#: Lines of a key that are compared in pairs; of a larger one so many are compared with all others at first.
PAIRED, REPS = 8, 2


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def smallest_hashes(lines: list[str], block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(lines, BINS): the least hash of each bin, none of them empty; and the number of shingles of each line.

    Lines stand one after the other as code points, each with SHINGLE - 1 zeros behind it, and are
    hashed together, at most block places at once; what begins behind a line's last shingle doesn't count.
    """
    points = np.frombuffer(("\0" * (SHINGLE - 1)).join([*lines, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(x) for x in lines], np.int64)
    ends = np.cumsum(sizes + SHINGLE - 1)
    windows = np.maximum(sizes - SHINGLE + 1, 1)
    begins = ends - sizes - SHINGLE + 1
    out = np.full(len(lines) * BINS, _NONE, np.uint64)
    last = int(begins[-1] + windows[-1]) if lines else 0
    for at in range(0, last, block):
        end = min(at + block, last)
        low, high = np.searchsorted(ends, at, "right"), np.searchsorted(begins, end)
        own = np.minimum(ends[low:high], end) - np.maximum(begins[low:high], at)
        line = np.repeat(np.arange(low, high), own)
        counts = np.arange(at, end) < (begins + windows)[line]
        h = points[at:end].copy()
        for j in range(1, SHINGLE):
            h *= np.uint64(0x100000001B3)
            h += points[at + j : end + j]
        h = _mixed(_mixed(h))[counts]
        np.minimum.at(out, line[counts] * BINS + (h >> np.uint64(58)).astype(np.int64), _mixed(h))
    out = out.reshape(len(lines), BINS)
    return _filled(out), windows


_NONE = np.uint64(2**64 - 1)
_RANDOM = np.random.default_rng(5)
#: Bins that an empty one looks at in turn, and the bins of each band.
_DONORS = np.stack([_RANDOM.permutation(BINS) for _ in range(BINS)])
_OF_BAND = np.concatenate([_RANDOM.permutation(BINS)[: ROWS * (BINS // ROWS)] for _ in range(-(-BANDS // (BINS // ROWS)))])[: BANDS * ROWS]


def _filled(smallest: np.ndarray) -> np.ndarray:
    """Empty bins get the value of the first of their donors that has one."""
    out = smallest.copy()
    rows, bins = np.nonzero(out == _NONE)
    for turn in range(BINS):
        if not len(rows):
            break
        found = smallest[rows, _DONORS[bins, turn]]
        out[rows, bins] = found
        left = found == _NONE
        rows, bins = rows[left], bins[left]
    return out


def band_keys(smallest: np.ndarray) -> np.ndarray:
    """(lines, BANDS): the keys of each line's bands."""
    rows = smallest[:, _OF_BAND].reshape(len(smallest), BANDS, ROWS)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(smallest), 1))
    for r in range(ROWS):
        keys = _mixed(keys * np.uint64(0x100000001B3) + rows[:, :, r])
    return keys.view(np.int64)


def sketches(smallest: np.ndarray) -> np.ndarray:
    """A bit of each bin's value."""
    bits = (_mixed(smallest) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64).ravel()


def line_key(line: str) -> int | None:
    """xxhash64 as Spark has it; none for a blank line."""
    from xxhash import xxh64_intdigest

    if not line.strip(" "):
        return None
    h = xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def split_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))
    return rows.withColumn("key", F.when(F.trim("line") != "", F.xxhash64("line")))


def signatures(docs: DataFrame, text: str, batch: int = 256) -> DataFrame:
    """(key, size, sketch, keys): of each line that isn't blank, once for those of some texts that are read together. key: of the line; size: its shingles, repeats included; keys: of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                distinct = dict.fromkeys(x for t in whole.column(0).slice(at, batch).to_pylist() for x in (t or "").split("\n"))
                lines = {x: k for x in distinct if (k := line_key(x)) is not None}
                smallest, sizes = smallest_hashes([*lines])
                offsets = pa.array(np.arange(0, len(lines) * BANDS + 1, BANDS, np.int32))
                bands = pa.ListArray.from_arrays(offsets, pa.array(band_keys(smallest).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(lines.values(), pa.int64()), pa.array(sizes), pa.array(sketches(smallest)), bands], names=["key", "size", "sketch", "keys"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "key long, size long, sketch long, keys array<long>")


#: What a member of a band's key is packed as, and the name of it.
_PACKED = {"bucket": np.int64, "key": np.int64, "size": np.uint8, "sketch": np.int64}
#: Parts that keys of bands are dealt to, and lines that are packed together.
PARTS, LOT = 1024, 1 << 15


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, size, sketch, keys) to (part, bucket, key, size, sketch): the members of a part's buckets, of a LOT of lines, as bytes."""

    def flush(lot: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(lot).combine_chunks()
        keys = rows.column("keys").chunk(0) if rows.num_rows else pa.array([], pa.list_(pa.int64()))
        bucket = keys.flatten().to_numpy()
        part = bucket.view(np.uint64) >> np.uint64(64 - PARTS.bit_length() + 1)
        order = np.argsort(part.astype(np.uint16), kind="stable")
        at = np.repeat(np.arange(rows.num_rows), pc.list_value_length(keys).to_numpy())[order]
        size = np.minimum(rows.column("size").to_numpy(), 255)
        values = {"bucket": bucket[order], "key": rows.column("key").to_numpy()[at], "size": size[at], "sketch": rows.column("sketch").to_numpy()[at]}
        parts, begins = np.unique(part[order], return_index=True)
        ends = np.append(begins, len(order))
        blobs = [pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer((ends * np.dtype(kind).itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values[c], kind))]) for c, kind in _PACKED.items()]
        return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), *blobs], names=["part", *_PACKED])

    lot, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, LOT):
            lot.append(batch.slice(at, LOT))
            n += lot[-1].num_rows
            if n >= LOT:
                yield flush(lot)
                lot, n = [], 0
    if lot:
        yield flush(lot)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From what _packed makes, sorted by part, to (bucket, key, size, sketch, members): each different line of the buckets that two of them have, once for each bucket."""

    def found(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        values = {c: np.frombuffer(b"".join(x for r in rows for x in r.column(c).to_pylist()), kind) for c, kind in _PACKED.items()}
        order = np.argsort(values["bucket"], kind="stable")
        bucket = values["bucket"][order]
        same = bucket[1:] == bucket[:-1]
        order = order[np.append(same, False) | np.insert(same, 0, False)]
        order = order[np.lexsort((values["key"][order], values["bucket"][order]))]
        bucket, key = values["bucket"][order], values["key"][order]
        first = np.append(True, bucket[1:] != bucket[:-1])[: len(order)]
        new = first | np.append(True, key[1:] != key[:-1])[: len(order)]
        order, begins = order[new], np.flatnonzero(first[new])
        members = np.diff(np.append(begins, len(order)))
        members = np.repeat(members, members)
        shared = order[members > 1]
        return pa.RecordBatch.from_arrays([*(pa.array(values[c][shared].astype(np.int64)) for c in _PACKED), pa.array(members[members > 1])], names=[*_PACKED, "members"])

    part, rows = None, []
    for batch in batches:
        parts = batch.column("part").to_numpy()
        ends = np.append(np.flatnonzero(parts[1:] != parts[:-1]) + 1, len(parts))
        for at, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
            if end > at:
                if rows and parts[at] != part:
                    yield found(rows)
                    rows = []
                part = parts[at]
                rows.append(batch.slice(at, end - at))
    if rows:
        yield found(rows)


def members_of_shared_keys(signed: DataFrame) -> DataFrame:
    """(bucket, key, own, members): lines by band key, for keys that at least two different lines have; members: how many.

    The keys of all bands are shuffled as bytes, of many lines in a row: a row for each key of each line took most of the time.
    A task holds one of the PARTS at once.
    """
    rows = signed.where("key is not null").select("key", "size", "sketch", "keys").mapInArrow(_packed, "part int, " + ", ".join(f"{c} binary" for c in _PACKED))
    shared = rows.repartition("part").sortWithinPartitions("part").mapInArrow(_shared, "bucket long, key long, size long, sketch long, members long")
    return shared.select("bucket", "key", F.struct("size", "sketch").alias("own"), "members")


def may_reach(a: Column, b: Column) -> Column:
    """Whether lines of these sizes and sketches are candidates."""
    short = F.least(a["size"], b["size"]) < LEAST
    return short | (F.bit_count(a["sketch"].bitwiseXOR(b["sketch"])) <= FAR)


def distinct_hashes(line: str) -> np.ndarray:
    """The distinct hashes of a line's shingles."""
    points = np.frombuffer(line.ljust(SHINGLE, "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n, h = len(points) - SHINGLE + 1, np.zeros(len(points) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        h = h * np.uint64(0x100000001B3) + points[j : j + n]
    return np.unique(_mixed(h))


def with_maps(texts: DataFrame) -> DataFrame:
    """texts (key, line) with mark: how many shingles differ from each other, and their bit map, as near_copies has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [distinct_hashes(x) for x in batch.column(1).to_pylist()]
            sizes, maps = pa.array([len(h) for h in hashes], pa.int64()), pa.array([bit_map(h) for h in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, maps], names=["key", "line", "size", "bits"])

    return texts.select("key", "line").mapInArrow(run, "key long, line string, size long, bits array<long>").select("key", "line", F.struct("size", "bits").alias("mark"))


def compare(pairs: DataFrame, texts: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose lines have a Jaccard similarity of at least SIMILARITY. texts: (key, line), also of other lines; held: some of those wanted, once each."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    if held is None:
        own = one_of_each(texts, wanted, "key", wanted.count())
    else:
        own = held.select("key", "line").join(wanted, "key", "left_semi")
        others = cut(wanted.join(held.select("key"), "key", "left_anti"))
        n = others.count()
        own = own.unionByName(one_of_each(texts, others, "key", n)) if n else own
    return with_texts(pairs, cut(own), "line").where(jaccard(F.col("text_a"), F.col("text_b")) >= SIMILARITY).select("a", "b")


def packed_shingles(line: str) -> np.ndarray | None:
    """A line's shingles as sorted distinct numbers, twelve bits a character; none if it is shorter than one or has other characters."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(points) < SHINGLE or points.max() >> 12:
        return None
    points = points.astype(np.uint64)
    n, out = len(points) - SHINGLE + 1, np.zeros(len(points) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        out = (out << np.uint64(12)) | points[j : j + n]
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def jaccard(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, own, packed = [], None, None, None
        for x, y in zip(a, b):
            if x != last:
                last, own, packed = x, None, packed_shingles(x)
            other = packed_shingles(y) if packed is not None else None
            if other is not None:
                both = np.concatenate([packed, other])
                both.sort(kind="stable")  # which merges runs
                common, n = np.count_nonzero(both[1:] == both[:-1]), len(both)
            else:
                own, other = own or shingles(x), shingles(y)
                common, n = len(own & other), len(own) + len(other)
            out.append(common / (n - common))
        return pd.Series(out, dtype="float64")

    return of(a, b)


def similar_lines(signed: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(a, b): verified links between lines, by key."""
    texts = split_lines(docs, doc_id, text).select("key", "line")
    held: list[DataFrame] = []

    def marks(keys: DataFrame, n: int) -> DataFrame:
        held.append(cut(with_maps(one_of_each(texts, keys, "key", n))))
        return held[0].select("key", "mark")

    return links_within_buckets(members_of_shared_keys(signed), lambda pairs: compare(pairs, texts, *held), may_reach, PAIRED, REPS, marks=marks, alike=may_equal)


def line_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, kept, keep_doc_id, keep_line_no, copies), one row for each line of each row of docs.

    keep_*: the occurrence that stays for this line; copies: occurrences of its component.
    """
    components = connected_components(similar_lines(signatures(docs, text), docs, doc_id, text))
    rows = cut(split_lines(docs, doc_id, text).select("doc_id", "line_no", "key"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    keys = rows.where("key is not null").groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # a line that occurs once and has no link stays by itself
    keys = cut(keys.join(components.withColumnRenamed("node", "key"), "key", "left").where("n > 1 or component is not null"))
    linked = keys.where("component is not null")
    whole = linked.groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("copies"), F.count("*").alias("nodes"))
    in_component = join_by_hot_key(linked.select("key", "component", "n"), whole, "component", "nodes", max(1, linked.count()))
    alone = keys.where("component is null").select("key", "n", F.col("first").alias("keep"), F.col("n").alias("copies"))
    groups = alone.unionByName(in_component.select("key", "n", "keep", "copies"))
    marked = sieved(rows, keys, "key", keys.count()).withColumn("_in", F.col("_in") & F.col("key").isNotNull())
    judged = join_by_hot_key(marked.where("_in").drop("_in"), groups, "key", "n", max(1, rows.count()), "left")
    alike = F.lit(None).cast(judged.schema["keep"].dataType).alias("keep"), F.lit(None).cast("long").alias("copies")
    judged = judged.unionByName(marked.where("not _in").select(*rows.columns, *alike))
    itself = F.expr("keep is null or doc_id <=> keep.doc_id and line_no = keep.line_no")
    keep = lambda c: F.when(F.col("keep").isNull(), F.col(c)).otherwise(F.col(f"keep.{c}")).alias(f"keep_{c}")
    return judged.select("doc_id", "line_no", itself.alias("kept"), keep("doc_id"), keep("line_no"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))


def without_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): each document's lines that stay, in order; documents whose lines all go get an empty text."""
    gone = line_groups(docs, doc_id, text).where("not kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(gone, "doc_id", "left")
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    return rows.select("doc_id", F.array_join(lines, "\n").alias("text"))
