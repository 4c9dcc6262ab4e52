"""Near copies of documents: five-word shingles with an exact Jaccard similarity of 0.8 or more.

The closest candidates come from SimHash: texts whose fingerprints, over five-word shingles, differ in at most
two bits, by simhash's covering search. Texts at a similarity of 0.8 differ in about ten, beyond what its masks cover.

The other candidates come from prefix filtering, which loses nothing: of n shingles the first n - ceil(0.8 n) + 1
in an order that all texts share are the keys, and two texts of a similarity of 0.8 share one of them.
The order puts frequent shingles last: first those that a sample of texts shows, then, in ORDERED
rounds, the keys that turn out to have more than CROWDED texts, counted over all of them; texts
that have such a key get their keys anew, all others keep theirs, since what stands after a text's
keys only moves further back. The order decides only how many candidates there are. Two texts meet
at a key only if it can be their first common one: as many shingles as they need must follow it in both.
Of two texts with sizes n and m and c common keys no more than c and
what one of them has beyond its keys can be common. Each text has a bit map besides, in which a shingle
turns one of MAP bits: two maps differ in no more bits than there are shingles that one text alone has, of which
two of a similarity of 0.8 have no more than (n + m) / 9. So most candidates go before any text is
read; the others are compared by their whole texts, as those of SimHash are. See links_within_buckets for large buckets.

Words are those of simhash.fingerprint: A-Z lowered, parted at ASCII white space. A text of fewer
than five words is one shingle; texts without words, null among them, are copies of each other.
A component's id is its smallest id that is not null; the row that has it stays, of several such
rows the one with the smallest key of its text. Rows that repeat both are judged alike. Columns
other than id and text aren't used, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import simhash
from lectern.llm.components import connected_components, join_by_hot_key, links_within_buckets, one_of_each, only_keys, sieved, with_texts
from lectern.session import cut

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Texts and shingles that decide the order of keys.
SAMPLE, FREQUENT = 4096, 1 << 16
#: Bits of a text's map, in longs.
MAP = 512
#: Keys of more texts than this are put last, the most frequent PUT_LAST of them in each of the rounds.
CROWDED, PUT_LAST, ORDERED = 8, 1 << 17, 1


def shingles(text: str | None) -> Iterator[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) > SHINGLE else iter([b" ".join(words)])


def all_hashes(text: str | None) -> np.ndarray:
    """XXH64 (seed 42) of a text's shingles, repeats included."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, shingles(text), repeat(SEED)), np.uint64)


def shingle_hashes(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(all_hashes(text))


def frequent(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that a sample of about SAMPLE texts has most, at most FREQUENT of them, sorted; and how many have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t.as_py()).view(np.int64))], names=["h"])

    some = docs.where(F.pmod(text_key(text), F.lit(max(1, docs.count() // SAMPLE))) == 0).select(text)
    rows = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    hashes, counts = rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prefix(hashes: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The keys of a text by the hashes of its shingles."""
    counts = np.zeros(len(hashes), np.int64)
    if len(often[0]):
        at = np.minimum(np.searchsorted(often[0], hashes), len(often[0]) - 1)
        counts = np.where(often[0][at] == hashes, often[1][at], 0)
    need = (4 * len(hashes) + 4) // 5
    return hashes[np.lexsort((hashes, counts))[: len(hashes) - need + 1]].view(np.int64)


def bit_map(hashes: np.ndarray) -> np.ndarray:
    """MAP bits as longs: whether an odd number of these distinct hashes falls on each."""
    odd = np.bincount((hashes % np.uint64(MAP)).astype(np.int64), minlength=MAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def put_last(often: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """often with these hashes after all that a sample showed; no hash moves forward."""
    both, at = np.unique(np.concatenate([often[0], hashes]), return_inverse=True)
    most = np.zeros(len(both), np.int64)
    np.maximum.at(most, at, np.concatenate([often[1], counts + (1 << 32)]))
    return both, most


def with_keys(rows: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """rows with size, keys, bits and fp in place of their last column, a text; size: how many shingles it has; keys: its prefix, in order; bits: its map; fp: its fingerprint."""
    *others, text = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                some = whole.slice(at, 256)
                sizes, keys, maps, prints = [], [], [], []
                for t in some.column(len(others)):
                    every = all_hashes(t.as_py())
                    hashes = np.unique(every)
                    sizes.append(len(hashes))
                    keys.append(prefix(hashes, often))
                    maps.append(bit_map(hashes))
                    prints.append(simhash.majority(every))
                made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64())), pa.array(prints, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(len(others))), *made], names=[*others, "size", "keys", "bits", "fp"])

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, f"{types}, size long, keys array<long>, bits array<long>, fp long")


def by_key(signed: DataFrame) -> DataFrame:
    """(bucket, key, own): a row for each key of each text, with its place among them."""
    return signed.select(F.posexplode("keys").alias("pos", "bucket"), "key", "size").select("bucket", "key", F.struct("size", "pos").alias("own"))


def shared_buckets(rows: DataFrame) -> DataFrame:
    return cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))


def reordered(signed: DataFrame, docs: DataFrame, text: str, often: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """(key, size, keys, bits) with crowded keys put last, and (bucket, n) of the keys that several texts have."""
    signed = signed.select("key", "size", "keys", "bits")
    shared = shared_buckets(by_key(signed))
    for _ in range(ORDERED):
        crowd = shared.where(F.col("n") > CROWDED).orderBy(F.desc("n"), "bucket").limit(PUT_LAST).toPandas()
        if not len(crowd):
            break
        often = put_last(often, crowd["bucket"].to_numpy(np.int64).view(np.uint64), crowd["n"].to_numpy(np.int64))
        crowded = F.broadcast(signed.sparkSession.createDataFrame(crowd[["bucket"]]))
        stale = cut(by_key(signed).join(crowded, "bucket", "left_semi").select("key").distinct())
        n = stale.count()
        # no text shuffles: those that only seem to be stale get the keys that they had
        texts = sieved(docs.select(text_key(text).alias("key"), F.col(text).alias("text")), stale, "key", n).where("_in").drop("_in")
        fresh = cut(with_keys(texts, often).drop("fp"))
        signed = sieved(signed, stale, "key", n).where("not _in").drop("_in").unionByName(fresh)
        some = cut(shared.select("bucket").unionByName(by_key(fresh).select("bucket")).distinct())
        shared = shared_buckets(sieved(by_key(signed), some, "bucket", some.count()).where("_in"))
    return signed, shared


def may_meet(a: Column, b: Column) -> Column:
    """Whether texts of these sizes can have the similarity if a key at these places is their first common one."""
    need = (a["size"] + b["size"]) * 4
    return ((a["size"] - a["pos"]) * 9 >= need) & ((b["size"] - b["pos"]) * 9 >= need)


def may_equal(a: Column, b: Column) -> Column:
    """Whether texts of these sizes and maps can have the similarity."""
    differ = sum((F.bit_count(a["bits"][i].bitwiseXOR(b["bits"][i])) for i in range(1, MAP // 64)), F.bit_count(a["bits"][0].bitwiseXOR(b["bits"][0])))
    return differ * 9 <= a["size"] + b["size"]


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def close(met: DataFrame, batch: int = 256) -> DataFrame:
    """(a, b): the pairs (a, b, text_a, text_b) whose texts have a Jaccard similarity of at least SIMILARITY; so many at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                some = whole.slice(at, batch)
                kept, last, own = [], None, set()
                for x, y in zip(some.column(2).to_pylist(), some.column(3).to_pylist()):
                    if x != last:
                        last, own = x, set(shingles(x))
                    other = set(shingles(y))
                    common = len(own & other)
                    kept.append(common >= SIMILARITY * (len(own) + len(other) - common))
                mask = pa.array(kept, pa.bool_())
                yield pa.RecordBatch.from_arrays([some.column(0).filter(mask), some.column(1).filter(mask)], names=["a", "b"])

    return met.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def can_reach(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) that can reach the similarity by their maps and their common keys."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    own = one_of_each(signed.select("key", F.struct("size", "keys", "bits").alias("own")), wanted, "key", wanted.count())
    met = with_texts(pairs, cut(own), "own")
    common = F.size(F.array_intersect("text_a.keys", "text_b.keys"))
    beyond = F.greatest(*(F.col(f"text_{x}.size") - F.size(f"text_{x}.keys") for x in "ab"))
    return met.where(may_equal(F.col("text_a"), F.col("text_b"))).where((common + beyond) * 9 >= (F.col("text_a.size") + F.col("text_b.size")) * 4).select("a", "b")


def simhash_pairs(signed: DataFrame) -> DataFrame:
    """(a, b): texts, by key, that the covering search links; texts of one fingerprint are paired with the smallest key of theirs."""
    texts = cut(signed.select("key", "fp").distinct())
    prints = cut(texts.groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("n")))
    equal = join_by_hot_key(texts, prints, "fp", "n", max(1, texts.count())).where("key <> first").select(F.col("first").alias("x"), F.col("key").alias("y"))
    a, b = (prints.select(F.col("fp").alias(side), F.col("first").alias(end)) for side, end in (("a", "x"), ("b", "y")))
    across = simhash.similar_pairs(prints.select("fp")).join(a, "a").join(b, "b").select("x", "y")
    return equal.unionByName(across).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_texts(signed: DataFrame, docs: DataFrame, text: str, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(a, b): verified links between texts, by key."""
    prints = signed.select("key", "fp")
    signed, shared = reordered(signed, docs, text, often)
    members = only_keys(by_key(signed), shared, "bucket", shared.count()).distinct()
    whole = docs.select(text_key(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def compare(pairs: DataFrame) -> DataFrame:
        pairs = cut(can_reach(pairs, signed))
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        texts = one_of_each(whole, wanted, "key", wanted.count())
        return close(with_texts(pairs, texts, "text"))

    marks = signed.select("key", F.struct("size", "bits").alias("mark"))
    return links_within_buckets(members, compare, may_meet, more=cut(simhash_pairs(prints)), marks=marks, alike=may_equal)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, component_id, kept), one row for each row of docs; key: of the text."""
    often = frequent(docs, text)
    signed = cut(with_keys(docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("key"), F.col(text).alias("text")), often))
    components = connected_components(similar_texts(signed, docs, text, often))
    keys = signed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    keys = cut(keys.join(components.withColumnRenamed("node", "key"), "key", "left"))
    best = F.struct(F.col("first").isNull().alias("none"), "first", F.col("key").alias("of"))
    linked = keys.where("component is not null")
    lowest = linked.groupBy("component").agg(F.min(best).alias("best"), F.count("*").alias("nodes"))
    joined = join_by_hot_key(linked.select("key", "component", "n"), lowest, "component", "nodes", max(1, linked.count()))
    groups = keys.where("component is null").select("key", "n", best.alias("best")).unionByName(joined.select("key", "n", "best"))
    judged = join_by_hot_key(signed.select("doc_id", "key"), groups, "key", "n", max(1, signed.count()))
    return judged.select("doc_id", "key", F.col("best.first").alias("component_id"), F.expr("key = best.of and doc_id <=> best.first").alias("kept"))


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; only rows that seem to go are shuffled."""
    mark = F.xxhash64("doc_id", "key")
    gone = cut(near_copies(docs, doc_id, text).where("not kept").select("doc_id", "key").distinct().withColumn("mark", mark))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("doc_id"), text_key(text).alias("key")).withColumn("mark", mark)
    marked = sieved(rows, gone, "mark", gone.count())
    left, right = marked.where("_in").alias("l"), gone.alias("r")
    same = (F.col("l.mark") == F.col("r.mark")) & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.key") == F.col("r.key"))
    return marked.where("not _in").select("_row.*").unionByName(left.join(right, same, "left_anti").select("_row.*"))
