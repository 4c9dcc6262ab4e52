"""Quality rules: what a text's words, lines and signs say, and a log-likelihood ratio of hashed n-grams.

DataFrame functions only. Words are maximal runs of anything but ASCII white space. The rules
count words, their characters, signs, repeated lines and words in repeated three-word windows; a text of
too few words, or of which too much repeats, fails.

The method's verdict compares two multinomials over BUCKETS hashed n-grams: one of the texts that
the labels call good (the trusted target), one of all texts (the raw corpus). Tokens are runs of letters
and digits and runs of other signs, letter case kept; each token and each two neighbours are an n-gram. An n-gram weighs the logarithm of its
smoothed share in the target over that in the corpus, in whole millionths, so that sums don't depend on
their order. A text's score is the mean weight of its n-grams; it stays if that is at least the threshold.
Every text is scored, with the same rule at any size.

Both multinomials count every row. The corpus is read to count and to score. No text
shuffles while the trusted ids are at most MOST_IDS; beyond, only trusted texts do. What reaches the driver and every task are BUCKETS weights.

Null texts count as empty. Rows that repeat count and are judged each by itself; of labels, an id is
trusted if all its rows say so, null labels and ids say nothing. Without trusted texts (an empty table too) every
weight is zero, and the rules alone decide. A null id is never trusted, but counts and is judged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import held_out_column
from lectern.llm.components import sieved

BUCKETS = 1 << 14
SMOOTHING = 1.0
#: The least mean weight, in millionths of a nat an n-gram, of a text that stays.
THRESHOLD = -150_000
LEAST_WORDS = 50
#: Ids of trusted texts that are broadcast; beyond, a filter of them is, and texts that pass it are joined by a shuffle.
MOST_IDS = 2_000_000
_POSITION_BITS = 24
#: Columns that rules and judge add; docs' own of these names go.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_grams", "llr", "kept", "_c", "_g", "_total")
_FAILED = f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words"
#: White space that parts words.
BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space."""
    return F.array_remove(F.split(F.translate(text, BLANKS[1:], " " * 5), " "), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(positions: Column) -> Column:
    """Words in the three-word windows at these sorted positions."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(positions, start, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(p - s["last"], F.lit(3))).alias("n")), lambda s: s["n"])


def _repeated_words(w: Column) -> Column:
    """Words of the array w in three-word windows that it holds twice or more.

    Forty bits of each window's hash and its position are one long; sorted, equal windows are neighbours. If
    the words of all neighbours with the same bits are equal, these are the repeated windows. Else, and for more
    words than positions have bits, the windows themselves are sorted.
    """
    low = (1 << _POSITION_BITS) - 1
    at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    packed = F.transform(w, lambda x, i: F.shiftleft(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), _POSITION_BITS).bitwiseOR(i.cast("long")))
    packed = F.sort_array(F.slice(packed, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))))
    like = lambda x: (F.get(w, x["a"]) == F.get(w, x["b"])) & (F.get(w, x["a"] + 1) == F.get(w, x["b"] + 1)) & (F.get(w, x["a"] + 2) == F.get(w, x["b"] + 2))
    window = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("at"))

    def by_hash(p: Column) -> Column:
        # the places where the next has the same bits; most texts have none
        same = lambda x, i: F.shiftright(x.bitwiseXOR(F.get(p, i + 1)), _POSITION_BITS) == 0
        some = F.filter(F.transform(p, lambda x, i: F.when(same(x, i), i)), lambda i: i.isNotNull())
        pairs = lambda k: F.transform(k, lambda i: F.struct(at(F.get(p, i)).alias("a"), at(F.get(p, i + 1)).alias("b")))
        counted = lambda q: F.when(F.forall(q, like), _covered(F.sort_array(F.concat(F.transform(q, lambda x: x["a"]), F.transform(q, lambda x: x["b"])))))
        return let(some, lambda k: F.when(F.size(k) == 0, F.lit(0).cast("long")).otherwise(let(pairs(k), counted)))

    def by_words(s: Column) -> Column:
        same = lambda i, j: (j >= 0) & F.coalesce(F.get(s, i)["w"] == F.get(s, j)["w"], F.lit(False))
        again = F.filter(F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["at"])), lambda x: x.isNotNull())
        return _covered(F.sort_array(again))

    found = let(packed, by_hash)
    sure = let(F.when(F.size(w) <= low, found), lambda n: F.when(n.isNotNull(), n).otherwise(let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window)), by_words)))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(sure)


def _counts(t: Column) -> Column:
    """The rules' counts of a text that isn't null."""
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def counts(parts: Column, w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.length(t) - F.size(parts) + 1).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated_words(w).alias("n_repeat_words"),
        )

    return let(F.split(F.translate(t, BLANKS[1:], " " * 5), " "), lambda parts: let(F.array_remove(parts, ""), lambda w: counts(parts, w)))


def _own(docs: DataFrame) -> DataFrame:
    return docs.drop(*(c for c in docs.columns if c in ADDED))


def rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    word_chars: code points in words. n_symbols: signs of #*$%&|<>. n_dup_lines: lines with a word that
    equal an earlier one. n_repeat_words: words in three-word windows that the text holds twice or more.
    """
    out = _own(docs).select("*", F.inline(F.array(_counts(F.coalesce(F.col(text), F.lit(""))))))
    return out.withColumn("base_failed", F.expr(_FAILED))


def tokens(text: Column) -> Column:
    """Hashes of runs of letters and digits, and of runs of other signs."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z0-9\\p{L}\\p{N}]++|[^\\p{L}\\p{N}\\s]++"), F.lit(0))
    return F.transform(found, lambda t: F.xxhash64(t))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1))


def _pair(k: Column, i: Column, token: Column) -> Column:
    """The bucket of a token, the i-th of k, with the one before it."""
    return _bucket(F.xxhash64(F.get(k, i - 1), token))


@dataclass(frozen=True)
class Ratio:
    """Weights of the buckets in millionths of a nat, and the n-grams that they rest on."""

    weights: tuple[int, ...]
    target: int
    raw: int


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Ratio:
    """The ratio of trusted texts (label 1, not held out) to all of docs."""
    trusted = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_good")).where("_good = 1")
    trusted = trusted.where(~held_out_column()).select(F.col("doc_id").cast("long").alias("_key"))
    rows = docs.select(F.col(doc_id).cast("long").alias("_key"), F.col(text).alias("_text"))
    n = trusted.count()
    trusted = trusted.withColumn("_good", F.lit(1))
    if n <= MOST_IDS:
        flagged = rows.join(F.broadcast(trusted), "_key", "left")
    else:  # only what may be trusted shuffles
        marked = sieved(rows, trusted, "_key", n)
        flagged = marked.where("not _in").withColumn("_good", F.lit(0)).unionByName(marked.where("_in").join(trusted, "_key", "left"), allowMissingColumns=True)
    grams = let(tokens(F.col("_text")), lambda k: F.concat(F.transform(k, _bucket), F.transform(F.slice(k, F.lit(2), F.greatest(F.size(k) - 1, F.lit(0))), lambda t, i: _pair(k, i + 1, t))))
    # outer, or Spark would make the n-grams once more to leave out texts without any
    each = flagged.select(F.explode_outer(grams).alias("bucket"), F.coalesce("_good", F.lit(0)).alias("_good")).where("bucket is not null")
    counted = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_good").alias("target"))
    raw, target = (np.zeros(BUCKETS) for _ in range(2))
    for row in counted.collect():  # at most BUCKETS rows
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    weights = np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS))
    return Ratio(tuple(int(w) for w in np.rint(weights * 1e6)) if target.any() else (0,) * BUCKETS, int(target.sum()), int(raw.sum()))


def judge(docs: DataFrame, ratio: Ratio, text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """docs with the rules' columns, n_grams, llr (mean weight of an n-gram in nats) and kept."""
    table = F.split(F.lit(",".join(map(str, ratio.weights))), ",").cast("array<bigint>")
    t = F.coalesce(F.col(text), F.lit(""))

    def total(k: Column) -> Column:
        weight = F.transform(k, lambda h, i: F.get(table, _bucket(h)) + F.when(i > 0, F.get(table, _pair(k, i, h))).otherwise(0))
        return F.struct(F.greatest(2 * F.size(k) - 1, F.lit(0)).cast("long").alias("n"), F.aggregate(weight, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))

    both = F.struct(_counts(t).alias("_c"), let(tokens(t), total).alias("_g"))
    rows = _own(docs).select("*", F.inline(F.array(both)))
    rows = rows.select(*(c for c in rows.columns if c not in ("_c", "_g")), "_c.*", F.expr(_FAILED.replace("n_", "_c.n_")).alias("base_failed"), F.col("_g.n").alias("n_grams"), F.col("_g.total").alias("_total"))
    kept = ~F.col("base_failed") & (F.col("_total") >= F.lit(threshold) * F.col("n_grams"))
    return rows.withColumns({"llr": F.coalesce(F.col("_total") / F.nullif("n_grams", F.lit(0)) / 1e6, F.lit(0.0)), "kept": kept}).drop("_total")
