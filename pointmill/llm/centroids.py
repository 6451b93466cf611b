"""Centroid clustering: Lloyd rounds over integer vectors with a vector-approximation file.

Each kept vector is written twice: whole, and as a code of a few bits for each dimension that names the cell its component lies in.
An assignment reads the codes alone: tables of the least and the greatest squared difference between a centroid and each cell add up to
an interval for the distance to every centroid, and a centroid whose interval begins beyond the end of another one is out. Whole vectors
are fetched (a join on the row's key) only where several intervals overlap, or where a vector changes its cluster, as the centroids'
sums are kept up by what moved. All sums are of integers, so results do not depend on order or layout.

What the driver holds is bounded by parameters: ``k`` centroids and the least and greatest component of each dimension.

Defined cases: a vector with another number of components, or with a null, NaN or infinite one, is left out; components beyond 2**20
after scaling count as 2**20; fewer vectors than ``k`` make fewer centroids; equal hashes of ids are ordered by the vectors; a null id is
hashed as empty text; repeated rows count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, id_type, map_batches, materialize

LIMIT = 2**20


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, *extra: Column) -> DataFrame:
    """``vec_id, v`` and ``extra``: floor(scale x) of the components of vectors without null, NaN or infinite ones."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    odd = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform(wide, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x * float(scale)))).cast("int"))
    return vectors.where(F.col(vector_col).isNotNull() & ~odd).select(F.col(id_col).alias("vec_id"), whole.alias("v"), *extra)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of integer lists of one length as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int32)


class Cells:
    """Cells of equal width between each dimension's least and greatest component, at most ``2**bits`` of them."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int):
        self.low, self.span, self.bits = low, high - low + 1, bits
        self.cells = np.minimum(self.span, 2**bits)

    def encode(self, v: np.ndarray) -> list[bytes]:
        cell = ((v - self.low) * self.cells // self.span).astype(np.uint8)
        bits = np.unpackbits(cell[:, :, None], axis=2)[:, :, 8 - self.bits :]
        packed = np.packbits(bits.reshape(len(v), -1), axis=1)
        return [row.tobytes() for row in packed]

    def decode(self, codes: list[bytes]) -> np.ndarray:
        d = len(self.low)
        packed = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        bits = np.unpackbits(packed, axis=1)[:, : d * self.bits].reshape(len(codes), d, self.bits)
        return bits.astype(np.int64) @ (1 << np.arange(self.bits - 1, -1, -1))

    def tables(self, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest squared difference to a centroid, by dimension and cell."""
        k = np.arange(2**self.bits)[None, :]
        edge = lambda i: -(-i * self.span[:, None] // self.cells[:, None]) + self.low[:, None]  # noqa: E731  the first value of cell i
        first, last, c = edge(k), edge(k + 1) - 1, centroid[:, None]
        least = np.maximum(np.maximum(first - c, c - last), 0)
        most = np.maximum(np.abs(c - first), np.abs(c - last))
        return least * least, most * most

    def intervals(self, codes: list[bytes], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the squared distance of every coded vector to every centroid."""
        cell, at = self.decode(codes), np.arange(len(self.low))
        low, high = np.empty((len(codes), len(centroids)), np.int64), np.empty((len(codes), len(centroids)), np.int64)
        for j, c in enumerate(centroids):
            least, most = self.tables(c)
            low[:, j], high[:, j] = least[at, cell].sum(axis=1), most[at, cell].sum(axis=1)
        return low, high


def _candidates(state: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """``key, code, prev, cluster, rivals``: by the codes alone; ``cluster`` is null where the intervals of ``rivals`` overlap."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        low, high = cells.intervals(batch.column(1).to_pylist(), centroids)
        left = low <= high.min(axis=1)[:, None]
        sole = left.sum(axis=1) == 1
        cluster = pa.array(left.argmax(axis=1).astype(np.int32), mask=~sole)
        rivals = pa.array([r.tobytes() for r in np.packbits(left, axis=1)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), cluster, rivals], names=["key", "code", "prev", "cluster", "rivals"])

    return map_batches(state.select("key", "code", F.col("cluster").alias("prev")), run, "key long, code binary, prev int, cluster int, rivals binary")


def _exact(fetched: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``key, code, prev, cluster, distance, v`` of ``fetched(key, code, prev, rivals, v)``: the nearest of the rivals, ties to the smaller number."""
    k = len(centroids)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = matrix(batch.column(4)).astype(np.int64)
        left = np.unpackbits(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(v), -1), axis=1)[:, :k].astype(bool)
        far = np.full((len(v), k), np.iinfo(np.int64).max)
        for j, c in enumerate(centroids):
            rows = np.flatnonzero(left[:, j])
            off = v[rows] - c
            far[rows, j] = (off * off).sum(axis=1)
        cluster = far.argmin(axis=1)
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(cluster.astype(np.int32)), pa.array(far[np.arange(len(v)), cluster]), batch.column(4)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "code", "prev", "cluster", "distance", "v"])

    return map_batches(fetched.select("key", "code", "prev", "rivals", "v"), run, "key long, code binary, prev int, cluster int, distance long, v array<int>")


def cluster_vectors(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, bits: int = 6, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every kept vector.

    The first centroids are the ``k`` vectors with the smallest sha256 of ``seed:id``. Each of ``rounds`` rounds assigns every vector to the
    nearest centroid and moves every centroid that has vectors to the floor of their mean; then vectors are assigned once more.
    """
    if not 1 <= bits <= 8 or k < 1:
        raise ValueError(f"out of range: bits {bits}, k {k}")
    spark, kind = vectors.sparkSession, id_type(vectors, id_col)
    kept = integer_vectors(vectors, id_col, vector_col, scale).where(F.size("v") == dims)
    full = materialize(kept.select(F.monotonically_increasing_id().alias("key"), "vec_id", "v"), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = full.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    box = full.agg(*[f(F.col("v")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("a", F.min), ("b", F.max))]).first()
    cells = Cells(np.array([box[f"a{i}"] for i in range(dims)], np.int64), np.array([box[f"b{i}"] for i in range(dims)], np.int64), bits)
    encode = lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells.encode(matrix(batch.column(1)).astype(np.int64)), pa.binary())], names=["key", "code"])
    codes = materialize(map_batches(full.select("key", "v"), encode, "key long, code binary"), "codes")
    state, sums, scratch = codes.withColumn("cluster", F.lit(-1)), np.zeros((len(centroids), dims + 1), dtype=object), [codes]
    for _ in range(rounds):
        seen = materialize(_candidates(state, cells, centroids), "candidates")
        fetch = seen.where("cluster is null or cluster <> prev").join(full.select("key", "v"), "key")
        found = _exact(fetch, centroids)
        moved = materialize(found.select("key", "code", "prev", "cluster", F.when(F.col("cluster") != F.col("prev"), F.col("v")).alias("v")), "moved")
        ways = F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")), F.struct(F.col("prev").alias("c"), F.lit(-1).alias("s")))).alias("w")
        change = moved.where("cluster <> prev").select("v", ways).where("w.c >= 0")
        for r in change.groupBy("w.c").agg(F.sum("w.s").alias("n"), *[F.sum((F.col("v")[i] * F.col("w.s")).cast("long")).alias(f"s{i}") for i in range(dims)]).collect():
            sums[r["c"]] += np.array([r["n"], *(r[f"s{i}"] for i in range(dims))], dtype=object)
        for c, (n, *s) in enumerate(sums.tolist()):
            if n:
                centroids[c] = [x // n for x in s]
        state = seen.where("cluster = prev").select("key", "code", "cluster").union(moved.select("key", "code", "cluster"))
        scratch += [seen, moved]
    last = _exact(_candidates(state, cells, centroids).join(full, "key"), centroids).select("key", "cluster", "distance")
    done = materialize(last.join(full.select("key", "vec_id"), "key").select("vec_id", "cluster", "distance"), "assigned")
    discard(full, *scratch)
    inertia = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
