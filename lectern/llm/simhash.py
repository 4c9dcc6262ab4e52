"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has 64 bits, each the majority of that bit over the XXH64 (seed 42)
of its word shingles. Fingerprints within two bits of each other are linked, and a document's
component is what links reach.

Search: bit i of the fingerprint gets the vector i mod 7 + 1 of GF(2)^3; table v (1 to 7) keeps
the bits whose vector has an odd product with v. Any two bits leave some v that keeps neither,
so every pair within two bits shares the key of at least one of the seven tables, each of 36
or 37 bits. Keys are met by distinct fingerprints only. A bucket of at most PAIRED is compared
in pairs; the members of a larger one are instead dealt to the 65 balls of radius one around
each: those who share a centre are within two bits, and two within two bits share a centre, so
nothing is lost, the work is linear, and a ball has at most 65 members.

Null and empty texts get fingerprint zero and are linked like any other. Null ids keep their
fingerprint; a component's id is its smallest id that is not null. Repeated rows are kept, each
with the same result. Columns other than id and text aren't used.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import connected_components, join_by_hot_key
from lectern.session import cut

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Buckets up to this size are compared in pairs.
PAIRED = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text; A-Z are lowered, words end at ASCII white space."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = iter([xxh64_intdigest(b" ".join(words), SEED)])
    else:
        hashes = map(xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(shingle)))), repeat(SEED))
    return majority(hashes)


def majority(hashes: Iterable[int]) -> int:
    """The signed integer of the bits that are 1 in over half the hashes."""
    ones, n, hashes = np.zeros(BITS, np.int64), 0, iter(hashes)
    while len(block := np.fromiter(islice(hashes, 16_384), np.uint64)):
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(block)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(text: Column) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return of(text)


def masks() -> list[int]:
    """The seven bit masks, as signed 64-bit integers."""
    found = []
    for v in range(1, 8):
        mask = sum(1 << i for i in range(BITS) if bin((i % 7 + 1) & v).count("1") % 2)
        found.append(mask - (1 << 64) if mask >> 63 else mask)
    return found


def signed_bit(i: int) -> int:
    return -(1 << 63) if i == 63 else 1 << i


def similar_pairs(distinct: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(a, b): links between distinct fingerprints in column fp, so that any two within RADIUS bits are connected.

    Links join only fingerprints within RADIUS; in a large bucket some follow from others.
    """
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for t, mask in enumerate(masks())))
    keyed = distinct.select("fp", F.inline(tables))
    keyed = keyed.select("fp", F.xxhash64("t", "key").alias("bucket"))
    buckets = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sized = buckets.select("bucket", F.col("n"), F.col("n").alias("members"))
    members = cut(join_by_hot_key(keyed, sized, "bucket", "n", max(1, distinct.count() * 7)))
    few = members.where(F.col("members") <= paired)
    left, right = few.select("bucket", F.col("fp").alias("a")), few.select("bucket", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    pairs = left.join(right, (left["bucket"] == right["bucket"]) & (F.col("a") < F.col("b")) & near).select("a", "b")
    many = members.where(F.col("members") > paired).select("fp").distinct()
    centres = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed_bit(i))) for i in range(BITS)))
    balls = many.select("fp", F.explode(centres).alias("centre")).groupBy("centre").agg(F.collect_set("fp").alias("ball")).where(F.size("ball") > 1)
    stars = balls.select(F.array_min("ball").alias("a"), F.explode("ball").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs."""
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    components = connected_components(similar_pairs(distinct))
    joined = components.join(distinct, components["node"] == distinct["fp"]).select("fp", "component", "first", "n")
    joined = cut(joined)
    lowest = joined.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("nodes"))
    linked = join_by_hot_key(joined, lowest, "component", "nodes", max(1, joined.count()))
    alone = distinct.join(joined.select("fp"), "fp", "left_anti").select("fp", "n", F.col("first").alias("component_id"))
    groups = alone.unionByName(linked.select("fp", "n", "component_id"))
    return join_by_hot_key(rows, groups, "fp", "n", max(1, rows.count())).select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
