"""Model providers as functions over Arrow batches, with deterministic stand-ins."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.rows import split_candidates

DIMENSIONS = 384
_TOKENS = re.compile("[㐀-䶿一-鿿豈-﫿]+|[^\\W_]+")
_HAN = re.compile("[㐀-䶿一-鿿豈-﫿]")


def _fnv1a(token: str) -> int:
    """FNV-1a over UTF-16 units, with its published offset and prime."""
    units, h = np.frombuffer(token.encode("utf-16-le", "surrogatepass"), "<u2"), 2166136261
    for u in units.tolist():
        h = (h ^ u) * 16777619 & 0xFFFFFFFF
    return h


@lru_cache(1 << 16)
def _places(token: str, dimensions: int) -> tuple[tuple[int, float], ...]:
    """The places that a token is hashed to, with what it adds there."""
    h = _fnv1a(token)
    own = (h % dimensions, 1.0 if h % 2 == 0 else -1.0)
    return (own, ((h >> 9) % dimensions, 0.5)) if len(token) > 3 else (own,)


def _hashed(text: str | None, dimensions: int) -> np.ndarray:
    flat = text or ""
    flat = (flat if flat.isascii() else unicodedata.normalize("NFKC", flat)).lower()
    at, add = [], []
    for run, n in Counter(_TOKENS.findall(flat)).items():
        grams = [run[i : i + k] for k in (1, 2, 3) for i in range(len(run) - k + 1)] if _HAN.match(run) else [run]
        for token in grams:
            # long tokens are rare and would fill the cache
            for place, value in (_places if len(token) <= 32 else _places.__wrapped__)(token, dimensions):
                at.append(place)
                add.append(n * value)
    # sums of halves are exact in any order
    out = np.bincount(np.array(at, np.int64), np.array(add, np.float64), dimensions)
    length = float(np.sqrt(out @ out))
    return (out / length if length else out).astype(np.float32)


def hash_embedding(text: str | None, dimensions: int = DIMENSIONS) -> list[float]:
    """Words, and Han characters by ones to threes, hashed to signed places; of length one, or zero for no words."""
    return _hashed(text, dimensions).tolist()


Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def _recovered(texts: list[str], embed: Embedder, depth: int = 6) -> list[list[float] | None]:
    """Embeds a batch; on failure its halves; a text that fails alone, at the depth's end, gets none."""
    try:
        return list(embed(texts))
    except RuntimeError:
        if len(texts) == 1 or not depth:
            return [None] * len(texts)
        half = len(texts) // 2
        return _recovered(texts[:half], embed, depth - 1) + _recovered(texts[half:], embed, depth - 1)


def embedded(chunks: DataFrame, embed: Embedder, text: str = "text", batch: int = 64) -> DataFrame:
    """chunks with embedding array<float>, null where the provider fails."""

    @F.pandas_udf("array<float>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = [t or "" for t in texts]
            yield pd.Series([v for i in range(0, len(values), batch) for v in _recovered(values[i : i + batch], embed)], dtype=object)

    return chunks.withColumn("embedding", of(F.col(text)))


def hash_embedder(texts: list[str]) -> list[np.ndarray]:
    return [_hashed(t, DIMENSIONS) for t in texts]


Scorer = Callable[[str, list[str]], list[float]]


def overlap_score(query: str, texts: list[str]) -> list[float]:
    """The share of the query's words that a text has."""
    words = set(re.findall(r"\w+", query.lower()))
    return [len(words & set(re.findall(r"\w+", t.lower()))) / max(1, len(words)) for t in texts]


def reranked(hits: DataFrame, scorer: Scorer, most: int = 8, query: str = "query", key: str = "query_id") -> DataFrame:
    """hits (query_id, query, file_id, chunk_idx, text, score) with rank: the first texts of a query's files, at
    most so many, by the scorer within 0..1; the rest follow as they were."""
    order = [F.desc("score"), "file_id", "chunk_idx"]
    split = split_candidates(hits, key, order, most)

    @F.pandas_udf("double")
    def of(queries: pd.Series, texts: pd.Series, lanes: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype="float64")
        for q, own in texts[lanes == "rerank"].groupby(queries[lanes == "rerank"], sort=False):  # a query's texts of a batch at once
            out[own.index] = [min(1.0, max(0.0, s)) for s in scorer(q, own.tolist())]
        return out

    scored = split.withColumn("rerank_score", of(F.col(query), F.col("text"), F.col("lane")))
    from pyspark.sql.window import Window

    place = Window.partitionBy(key).orderBy(F.desc_nulls_last("rerank_score"), *order)
    return scored.withColumn("rank", F.row_number().over(place)).drop("lane")


def merged_boxes(observations: DataFrame, least: float = 0.25) -> DataFrame:
    """(page_id, text): lines of a page (text, confidence, x, y, w, h, source) without repeats: by source and
    confidence, one that overlaps a kept line by the least share is left out; then in reading order.
    A page's lines are one group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in rows.sort_values(["source", "confidence"], ascending=[True, False]).itertuples():
            if all(_overlap(r, k) < least for k in kept):
                kept.append(r)
        kept.sort(key=lambda r: (round(r.y / max(1e-6, r.h)), r.x))
        return pd.DataFrame({"page_id": [rows["page_id"].iloc[0]], "text": ["\n".join(r.text for r in kept)]})

    return observations.groupBy("page_id").applyInPandas(run, "page_id long, text string")


def _overlap(a, b) -> float:
    width, height = min(a.x + a.w, b.x + b.w) - max(a.x, b.x), min(a.y + a.h, b.y + b.h) - max(a.y, b.y)
    return width * height / max(1e-9, min(a.w * a.h, b.w * b.h)) if width > 0 and height > 0 else 0.0


def tile_plan(width: Column, height: Column, tile: int = 2048, overlap: int = 288, most: int = 32) -> Column:
    """array<struct<x,y,w,h>>: tiles that cover a picture, at most so many, row by row."""

    def places(length: Column) -> Column:
        n = F.ceil(F.greatest(length - overlap, F.lit(1)) / (tile - overlap)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.least(i * (tile - overlap), F.greatest(length - tile, F.lit(0))))

    grid = F.flatten(F.transform(places(height), lambda y: F.transform(places(width), lambda x: F.struct(x.alias("x"), y.alias("y"), F.least(width - x, F.lit(tile)).alias("w"), F.least(height - y, F.lit(tile)).alias("h")))))
    return F.slice(grid, 1, most)
