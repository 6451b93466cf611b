"""Hard-negative mining over an inverted multi-index.

Vectors are cut into two halves, each half has a codebook, and a pair of codewords is a cell. A codeword's radius is the greatest distance
of a member's half to it, so for an anchor half ``a`` no member's half score exceeds ``a.c + |a| r`` or falls below ``a.c - |a| r``. A heap over the
two sorted lists of half bounds (the multi-sequence walk) visits the cells in the order of the sum of their upper bounds; an anchor is
certified, and stops, when the worst place of every one of its lists is filled by a score above the bound of the next cell. Cells whose lower bound
exceeds all windows are passed over.

The walk runs in rounds, each reaching ``growth`` times as many members as the one before. In a round an anchor asks the blocks of its next
cells; at most ``chunk`` anchors meet a block of about ``block`` members in a cogroup, a matrix product scores them, and only the best few of
a list leave it. So no pair is ever a row, a cell that holds a third of all vectors is as many blocks as it needs, and vectors on which bounds
prune nothing (random directions) cost one blocked pass of the anchors over all rows. Results are exact: the codebooks, fitted on a bounded sample, decide only
the order of visits.

Defined cases: rows with a null id or label, a null vector or a null, NaN or infinite component take no part; shorter vectors are filled
with zeros; components beyond 2**20 after scaling count as 2**20; repeated rows are rows of their own, a twin counts as another row; an
anchor without positives or negatives gives no row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .centroids import integer_vectors, matrix
from .common import discard, map_batches, materialize

NONE = np.iinfo(np.int64).min
LISTS = "array<struct<name: int, low: long, high: long, worst: long>>"


def fit_half(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """A codebook of at most ``k`` words for the rows of a bounded sample, begun at rows spread evenly over them."""
    x = np.unique(x, axis=0)
    words = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        near = nearest_word(x, words)
        n = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def nearest_word(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(axis=1)[None, :] - 2 * (x @ words.T)).argmin(axis=1)


class Index:
    """Codebooks, radii and the number of members and blocks of each occupied cell; at most ``k**2`` cells."""

    def __init__(self, words: list[np.ndarray]):
        self.words = words
        self.cut = words[0].shape[1]

    def cells_of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        halves = v[:, : self.cut], v[:, self.cut :]
        at = [nearest_word(h, w) for h, w in zip(halves, self.words, strict=True)]
        far = [np.sqrt(((h - w[i]) ** 2).sum(axis=1)) for h, w, i in zip(halves, self.words, at, strict=True)]
        return at[0] * len(self.words[1]) + at[1], *far

    def measure(self, members: list[tuple[int, int, float, float]], block: int) -> None:
        """From ``cell, n, far0, far1`` of every occupied cell."""
        n1 = len(self.words[1])
        self.size = {c: n for c, n, _, _ in members}
        self.radius = [np.zeros(len(w)) for w in self.words]
        for c, _, f0, f1 in members:
            i, j = divmod(c, n1)
            self.radius[0][i], self.radius[1][j] = max(self.radius[0][i], f0), max(self.radius[1][j], f1)
        # Rounding is far below a millionth of a bound.
        self.radius = [r * (1 + 1e-6) + 1e-6 for r in self.radius]
        self.blocks = {c: -(-n // block) for c, n in self.size.items()}

    def walk(self, a: np.ndarray):
        """``upper, lower, cell`` of the occupied cells for an anchor, by falling upper bound: a heap over both sorted lists of half bounds."""
        mid = [w @ h for w, h in zip(self.words, (a[: self.cut], a[self.cut :]), strict=True)]
        room = [r * np.linalg.norm(h) for r, h in zip(self.radius, (a[: self.cut], a[self.cut :]), strict=True)]
        up, down = [m + r for m, r in zip(mid, room, strict=True)], [m - r for m, r in zip(mid, room, strict=True)]
        order = [np.argsort(-u, kind="stable") for u in up]
        heap, n0, n1 = [(-(up[0][order[0][0]] + up[1][order[1][0]]), 0, 0)], len(up[0]), len(up[1])
        while heap:
            u, i, j = heapq.heappop(heap)
            x, y = int(order[0][i]), int(order[1][j])
            if j + 1 < n1:
                heapq.heappush(heap, (-(up[0][x] + up[1][order[1][j + 1]]), i, j + 1))
            if j == 0 and i + 1 < n0:
                heapq.heappush(heap, (-(up[0][order[0][i + 1]] + up[1][y]), i + 1, 0))
            if (cell := x * n1 + y) in self.size:
                yield 1e-6 - u, down[0][x] + down[1][y] - 1e-6, cell


def _asks(anchors: DataFrame, index: Index, first: int, last: int, chunks: int) -> DataFrame:
    """``cell, block, chunk, key, label, v, lists``: the anchors with each block of the cells that begin between the ``first`` and the ``last`` member of
    their walk and can change one of their ``lists(name, low, high, worst)``; ``worst`` is the last score of a full list, else null."""

    def run(batch: pa.RecordBatch):
        rows, cells, blocks = [], [], []
        for n, (v, lists) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            low, high, seen = min(x["low"] for x in lists), max(x["high"] for x in lists), 0
            for upper, lower, cell in index.walk(np.array(v, float)):
                if seen >= last or not any(upper >= x["low"] and (x["worst"] is None or upper >= x["worst"]) for x in lists):
                    break  # certified, or the end of this round
                if seen >= first and lower <= high and upper >= low:
                    for b in range(index.blocks[cell]):
                        rows.append(n), cells.append(cell), blocks.append(b)
                seen += index.size[cell]
        if rows:
            held = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(blocks, pa.int32()), *held.columns], names=["cell", "block", "key", "label", "v", "lists"])

    asks = map_batches(anchors.select("key", "label", "v", "lists"), run, f"cell int, block int, key long, label int, v array<int>, lists {LISTS}")
    return asks.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)))


def _scored(asks: DataFrame, members: DataFrame, *, same: bool, take: int) -> DataFrame:
    """``key, name, score, id, mkey``: the best ``take`` members of each block for each list of each anchor that asks it."""
    by = ["cell", "block", "chunk"]
    asked = members.join(asks.select(*[F.col(c).alias(c) for c in by]).distinct(), ["cell", "block"]).select(*by, "mkey", "id", "mlabel", "mv")
    schema = pa.schema([("key", pa.int64()), ("name", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("mkey", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by([("id", "ascending"), ("mkey", "ascending")]).combine_chunks()
        ids, mkeys, mlabels = (right[c].to_numpy() for c in ("id", "mkey", "mlabel"))
        m, out = matrix(right["mv"].combine_chunks()).astype(float), []
        for at in range(0, left.num_rows, 256):
            part = left.slice(at, 256).combine_chunks()
            keys, labels, lists = part["key"].to_numpy(), part["label"].to_numpy(), part["lists"].to_pylist()
            scores = (matrix(part["v"].combine_chunks()).astype(float) @ m.T).astype(np.int64)
            fit = (labels[:, None] == mlabels[None, :]) == same
            if same:
                fit &= keys[:, None] != mkeys[None, :]
            for turn in range(max(map(len, lists))):
                rows = np.array([n for n, x in enumerate(lists) if turn < len(x)])
                edge = np.array([[lists[n][turn]["low"], lists[n][turn]["high"]] for n in rows], dtype=np.int64)
                some = np.where(fit[rows] & (scores[rows] >= edge[:, :1]) & (scores[rows] <= edge[:, 1:]), scores[rows], NONE)
                for _ in range(min(take, len(ids))):
                    best = some.argmax(axis=1)  # members are in the order of ids, so ties go to the smaller one
                    top = some[np.arange(len(rows)), best]
                    some[np.arange(len(rows)), best] = NONE
                    for n, b, s in zip(rows[top > NONE], best[top > NONE], top[top > NONE], strict=True):
                        out.append((keys[n], lists[n][turn]["name"], s, ids[b], mkeys[b]))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return asks.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, "key long, name int, score long, id long, mkey long")


def search(anchors: DataFrame, lists: DataFrame, members: DataFrame, index: Index, *, same: bool, take: int, first: int, growth: int, chunk: int) -> DataFrame:
    """``key, name, rank, score, id``: for every list ``key, name, low, high`` of the anchors ``key, label, v`` the best ``take`` members between its
    bounds that have the anchor's label, or with ``same`` false another one. Exact."""
    total, chunks = sum(index.size.values()), max(1, -(-anchors.count() // chunk))
    order = Window.partitionBy("key", "name").orderBy(F.desc("score"), "id", "mkey")
    best, start, end = None, 0, first
    while best is None or start < total:
        known = lists.withColumn("worst", F.lit(None).cast("long"))
        if best is not None:
            full = best.where(F.col("rank") == take).select("key", "name", F.col("score").alias("worst"))
            known = lists.join(full, ["key", "name"], "left")
        held = known.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("name", "low", "high", "worst"))).alias("lists"))
        asks = materialize(_asks(anchors.join(held, "key"), index, start, end, chunks), "asks")
        found = _scored(asks, members, same=same, take=take)
        if best is not None:
            found = found.union(best.select(*found.columns))
        old, best = best, materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take), "best")
        discard(old, asks)
        start, end = end, end * growth
    return best


def hard_negatives(
    vectors: DataFrame, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50, scale: int = 256, words: int = 64, sample_rows: int = 8192,
    block: int = 2048, chunk: int = 8192, first: int = 4096, growth: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``, positives their first rows of the same label, negatives for each of these the first
    rows of other labels whose score is between ``low`` and ``high`` percent of the positive's. Scores are integer inner products of floor(scale x);
    higher ones come first, ties by the smaller id. Codebooks of at most ``words`` words a half, fewer for few rows, are fitted on the ``sample_rows``
    rows with the smallest hashes.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = vectors.sparkSession
    kept = integer_vectors(vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.struct(vector_col, label_col).alias("r")), "id", f"r.{vector_col}", scale, F.col(f"r.{label_col}").cast("int").alias("label"))
    kept = materialize(kept.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").alias("id"), "label", "v"), "vectors")
    n, dims = kept.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not dims:
        return spark.createDataFrame([], schema)
    full = kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(dims) - F.size("v"))))
    sample = np.array([r["v"] for r in full.select("v", F.xxhash64("key").alias("h"), "key").orderBy("h", "key").limit(sample_rows).collect()], dtype=float)
    k, cut = max(1, min(words, round((n / 1024) ** 0.5))), max(1, dims // 2)
    index = Index([fit_half(sample[:, :cut], k), fit_half(sample[:, cut:], k) if dims > 1 else np.zeros((1, 0))])

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell, far0, far1 = index.cells_of(matrix(batch.column(3)).astype(float))
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(far0), pa.array(far1), *batch.columns], names=["cell", "far0", "far1", "mkey", "id", "mlabel", "mv"])

    located = materialize(map_batches(full.select("key", "id", "label", "v"), placed, "cell int, far0 double, far1 double, mkey long, id long, mlabel int, mv array<int>"), "members")
    index.measure([tuple(r) for r in located.groupBy("cell").agg(F.count("*"), F.max("far0"), F.max("far1")).collect()], block)
    blocks = F.broadcast(spark.createDataFrame(list(index.blocks.items()), "cell int, blocks int"))
    members = located.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("mkey"), F.col("blocks")).cast("int").alias("block"), "mkey", "id", "mlabel", "mv")
    anchors = materialize(full.where(F.col("id") % every == 0), "anchors")
    how = {"first": first, "growth": growth, "chunk": chunk}
    ends = [F.lit(int(x)).alias(a) for a, x in (("low", NONE + 1), ("high", np.iinfo(np.int64).max))]
    near = search(anchors, anchors.select("key", F.lit(0).alias("name"), *ends), members, index, same=True, take=positives, **how)
    lists = near.select("key", F.col("rank").alias("name"), F.expr(f"-((-{low} * score - pmod(-{low} * score, 100L)) div 100)").alias("low"), F.expr(f"({high} * score - pmod({high} * score, 100L)) div 100").alias("high"))
    found = search(anchors, materialize(lists.where("low <= high"), "lists"), members, index, same=False, take=negatives, **how)
    pairs = near.select("key", F.col("rank").alias("name"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    discard(located)
    return found.select("key", "name", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["key", "name"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
