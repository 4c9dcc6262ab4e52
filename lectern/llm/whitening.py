"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

Entries become whole numbers, floor(scale * c) + offset, in blocks of rows that are kept as a table in the shared
folder. Sums are exact, so that centred rows don't depend on how they are dealt.

Let X be the centred rows. Each step takes a direction v, multiplies each block's rows with it in the
tasks (Xv), takes out the left vectors so far, and adds up the transposed product (X'u), the length of u and
its products with all earlier left vectors, from which u is fully reorthogonalised; the new direction is fully
reorthogonalised against all earlier ones, twice. A left vector has an entry for each row; it is never collected or kept, since
u = Xp with a p of as many entries as a row, which the tasks are given. So a step is one pass of the blocks,
of which the driver gets a few numbers for each dimension, and a lost executor's blocks are read again. Where a
subspace ends, another direction goes on, and there are as many steps as dimensions, so that equal variances are
found as often as they occur.

Of the small bidiagonal matrix, singular values give the variances, and right vectors, turned back, the components.

A vector that is null or holds null or non-finite entries is left out, as are entries beyond a long and vectors of another
length than the commonest (of equally common ones the longest); vectors that repeat, with or without their ids, count each.
Null ids stay null. Components whose variance is zero to working precision (fewer rows than dimensions, constant or
dependent dimensions) can't be whitened and are left out. An empty table has no rows.
A deviation beyond a long is null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import checkpoint_root

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows of a block.
BLOCK = 2048
#: What counts as zero beside the largest singular value.
TINY = 1e-13
_HALF = 26


def _whole(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, pa.Array]:
    """The usable rows of (id, vector) as long integers without the offset, and their ids."""
    vectors = batch.column("vector")
    right = pc.equal(pc.list_value_length(vectors), d).fill_null(False)
    ids, vectors = batch.column("id").filter(right), vectors.filter(right)
    flat = vectors.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, d)
    scaled = np.floor(flat * SCALE)
    good = (np.abs(scaled) < 2.0**62).all(axis=1)  # false for what isn't finite
    return scaled[good].astype(np.int64), ids.filter(pa.array(good))


def blocks(vectors: DataFrame, vec_id: str, embedding: str, d: int) -> DataFrame:
    """(ids, y): blocks of rows; y: their whole numbers without the offset, as little-endian integers of four or eight bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Array]] = []

        def packed() -> pa.RecordBatch:
            y, ids = np.concatenate([x for x, _ in held]), pa.concat_arrays([i for _, i in held])
            held.clear()
            narrow = np.abs(y).max() < 1 << 31
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([listed, pa.array([y.astype("<i4" if narrow else "<i8").tobytes()], pa.binary())], ["ids", "y"])

        for batch in batches:
            y, ids = _whole(batch, d)
            for at in range(0, len(y), BLOCK):
                held.append((y[at : at + BLOCK], ids[at : at + BLOCK]))
                if sum(len(x) for x, _ in held) >= BLOCK:
                    yield packed()
        if held:
            yield packed()

    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    return rows.where("vector is not null").mapInArrow(of, "ids array<bigint>, y binary")


def _read(y: pa.Buffer, n: int, d: int) -> np.ndarray:
    return np.frombuffer(y, "<i4" if len(y) == 4 * n * d else "<i8").reshape(n, d).astype(np.int64)


@dataclass
class Blocks:
    """The table of blocks with what is known of all rows."""

    table: DataFrame
    d: int
    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.floor = [s // self.n for s in self.sums]
        self.rest = [s - self.n * m for s, m in zip(self.sums, self.floor, strict=True)]

    def centred(self):
        """A function from a block's bytes to its centred rows."""
        d, floor, rest = self.d, np.array(self.floor, np.int64), np.array(self.rest, np.float64) / self.n
        return lambda y, n: (_read(y, n, d) - floor).astype(np.float64) - rest

    def summed(self, product, size: int) -> np.ndarray:
        """The sum over all blocks of what product makes of centred rows, an array of this size."""
        centred = self.centred()

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for n, y in zip(batch.column("n").to_pylist(), batch.column("y"), strict=True):
                    total += product(centred(y.as_buffer(), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["i", "x"])

        parts = self.table.select(F.size("ids").alias("n"), "y").mapInArrow(of, "i int, x double")
        out = np.zeros(size)
        for row in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():  # one row for each number
            out[row["i"]] = row["x"]
        return out


def laid_out(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> Blocks | None:
    """The blocks of all usable vectors, written to the shared folder, and their exact sums; none if there are none."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    lengths = vectors.where(finite & (F.size(embedding) > 0)).groupBy(F.size(embedding).alias("d")).agg(F.count("*").alias("n"))
    commonest = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if commonest is None:
        return None
    d = commonest["d"]
    spark = vectors.sparkSession
    folder = f"{checkpoint_root(spark)}/whitening-{uuid.uuid4().hex}"
    blocks(vectors, vec_id, embedding, d).write.parquet(folder)
    table = spark.read.parquet(folder)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            for n, y in zip(batch.column("n").to_pylist(), batch.column("y"), strict=True):
                rows = _read(y.as_buffer(), n, d)
                high, low = high + (rows >> _HALF).sum(0), low + (rows & (1 << _HALF) - 1).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(high), pa.array(low)], ["i", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    n = table.agg(F.sum(F.size("ids").cast("long"))).first()[0]
    if not n:
        return None
    rows = table.select(F.size("ids").alias("n"), "y").mapInArrow(sums, "i int, high bigint, low bigint").groupBy("i").agg(exact("high"), exact("low")).collect()
    return Blocks(table, d, n, [(int(r["high"]) << _HALF) + int(r["low"]) for r in sorted(rows, key=lambda r: r["i"])])


@dataclass(frozen=True)
class Components:
    """Columns of vectors: unit components by falling variance; the variances; trace: the sum of all variances."""

    vectors: np.ndarray
    variances: np.ndarray
    trace: float


def _outside(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """v without its part in the space of the orthonormal basis."""
    for _ in range(2):
        for b in basis:
            v = v - b * (b @ v)
    return v


def bidiagonalise(x: Blocks, wanted: int = COMPONENTS, seed: int = 13) -> Components:
    """The wanted components by alternating products with the centred rows and their transpose."""
    d, rng = x.d, np.random.default_rng(seed)
    trace = float(x.summed(lambda rows: np.array([np.einsum("ij,ij->", rows, rows)]), 1)[0]) / x.n
    scale = np.sqrt(trace * x.n)
    right: list[np.ndarray] = []  # v, d entries each
    left: list[np.ndarray] = []  # p with u = Xp, for the steps that have a u
    images: list[np.ndarray] = []  # X'u of these
    alphas: list[float] = []
    betas: list[float] = []
    v, beta = _outside(rng.standard_normal(d), []), 0.0
    v /= np.linalg.norm(v)
    while scale > 0 and len(right) < d:
        right.append(v)
        p = v - beta * left[-1] if beta else v
        stack = np.array([p, *left]).T  # d x (1 + earlier ones)

        def product(rows: np.ndarray, stack=stack) -> np.ndarray:
            u = rows @ stack
            return np.concatenate([rows.T @ u[:, 0], u.T @ u[:, 0]])

        out = x.summed(product, d + stack.shape[1])
        image, length, overlap = out[:d], out[d], out[d + 1 :]
        if left:  # Gram-Schmidt against all earlier left vectors
            p = p - np.array(left).T @ overlap
            image = image - np.array(images).T @ overlap
        alpha = np.sqrt(max(0.0, length - overlap @ overlap))
        if alpha > TINY * scale:
            left.append(p / alpha)
            images.append(image / alpha)
            alphas.append(alpha)
            v = _outside(images[-1] - alpha * right[-1], right)
        else:
            alphas.append(0.0)
            v = np.zeros(d)
        beta = float(np.linalg.norm(v))
        if beta <= TINY * scale:
            beta = 0.0
            v = _outside(rng.standard_normal(d), right)
        v = v / np.linalg.norm(v) if len(right) < d else v
        betas.append(beta)
    vectors, values = np.zeros((d, 0)), np.zeros(0)
    if right:
        b = np.diag(alphas) + np.diag(betas[:-1], 1)
        _, values, turned = np.linalg.svd(b)
        keep = values > max(d, 2) * TINY * scale
        values = values[keep][:wanted]
        vectors = (np.array(right).T @ turned.T)[:, keep][:, :wanted]
    return Components(vectors, values**2 / x.n, trace)


def whitened(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    deviation: the exact sum over dimensions of (n x - S)^2. whitened: the centred row on the component over
    the root of its variance. explained: the component's share of the variance. identity_error: the largest
    absolute entry of the whitened rows' covariance less the identity, one value for all.
    """
    x = laid_out(vectors, vec_id, embedding)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if x is None:
        return vectors.sparkSession.createDataFrame([], schema)
    found = bidiagonalise(x, components)
    k = len(found.variances)
    turn = found.vectors / np.sqrt(found.variances)

    def moments(rows: np.ndarray) -> np.ndarray:
        z = rows @ turn
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    sums = x.summed(moments, k + k * k) / x.n if k else np.zeros(0)
    error = float(np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k)).max()) if k else 0.0
    explained = found.variances / found.trace if k else found.variances
    names = [f.split()[0] for f in schema.split(", ")]
    centred, n, d = x.centred(), x.n, x.d
    floor, rest = np.array(x.floor, np.int64), x.rest

    def deviations(y, rows: int) -> list[int | None]:
        """n x - S is n times the whole part of the centred entry less the rest."""
        whole = _read(y, rows, d) - floor
        if (int(np.abs(whole).max(initial=0)) + 1) * n < int((2**62 / d) ** 0.5):
            return ((n * whole - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        each = (sum((n * int(a) - b) ** 2 for a, b in zip(row, rest, strict=True)) for row in whole)
        return [v if v < 1 << 63 else None for v in each]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, y in zip(batch.column("ids"), batch.column("y"), strict=True):
                ids, y = ids.values, y.as_buffer()
                z = centred(y, len(ids)) @ turn
                each = np.repeat(np.arange(len(ids)), k)
                columns = [
                    ids.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1), len(ids)), pa.int32()),
                    pa.array(np.full(len(each), n), pa.int64()),
                    pa.array(deviations(y, len(ids)), pa.int64()).take(pa.array(each)),
                    pa.array(z.ravel()),
                    pa.array(np.tile(explained, len(ids))),
                    pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return x.table.mapInArrow(scored, schema)
