"""Quality by Bradley-Terry pairwise ranking.

Each text has a vector of measures. For pairs of a good and a bad labelled text the probability that the good one wins is the
logistic function of the difference of their scores, a linear function of the measures; the weights minimise the logistic loss on
feature differences. The cut is a quantile of scores: the share of bad texts among the labelled ones. Scores are then mapped to
0..1 so that the cut falls on ``CUT``, with the slope that fits the labels best.

The fit takes every pair of all labelled texts, never held-out ones; the pairs of a bad text weigh as much together as ``pairs_each`` of them. No pair is listed: what
a pair adds depends on the two scores through one smooth function of their difference, so the texts of one class are summed at the nodes of a polynomial
over the scores, exact to rounding, and those of the other by what they take from each node (``pair_sums``). Measures are taken once, in one pass over all texts.

Defined cases: a null text is empty; an empty text has zero measures and is scored like any other; with no labels of one class
every score is 0.5; an id with several labels counts with the largest; repeated rows get equal scores; an empty table gives an
empty result; other columns, ids included, are not measures. Texts are measured whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, empty_if_null, held_out, map_batches, materialize
from .learning import sigmoid

CUT = 0.3
#: Groups of bytes whose share of the text is a measure.
GROUPS = (b"#*$%&<>", b"|", b"!", b"?", b".", b",", b";:", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b"=/\\_+~^`@", b"()[]{}\"'", b"\n", bytes(range(128, 256)))
MEASURES = len(GROUPS) + 8


def measures(text: bytes) -> list[float]:
    """The measures of one text, all within small bounds."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * MEASURES
    hist = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    shares = [float(np.sqrt(hist[list(g)].sum() / len(text))) for g in GROUPS]
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    distinct = len(set(words))
    letters = max(1, int(hist[65:91].sum() + hist[97:123].sum()))
    return [
        *shares,
        float(np.log1p(n)) / 10,
        distinct / n,
        float(np.log(distinct) / np.log(n)) if n > 1 else 1.0,
        min(2.0, float(lengths.mean()) / 10),
        min(2.0, float(lengths.std()) / 10),
        1 - len(set(lines)) / max(1, len(lines)),
        float(hist[65:91].sum()) / letters,
        min(2.0, float(np.log1p(n / len(lines))) / 5),
    ]


@dataclass(frozen=True)
class Ranking:
    """A fitted ranking: centre and scale of the measures, weights, and the map of scores to 0..1."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((self.raw(x) - self.cut) * self.slope + np.log(CUT / (1 - CUT)) + 1e-9) if self.slope else np.full(len(x), 0.5)


def preference_pairs(good: int, bad: int, each: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bad text ``each`` good ones, or all if there are fewer, dealt out evenly."""
    each = min(each, good)
    b = np.repeat(np.arange(bad), each)
    return (b * each + np.tile(np.arange(each), bad)) % good, b


def nodes_of(low: float, high: float) -> np.ndarray:
    """Places at which a polynomial settles the logistic function from ``low`` to ``high`` to rounding: its poles lie pi off the axis."""
    half = max((high - low) / 2, 0.5) * (1 + 1e-9)
    return (low + high) / 2 + half * np.cos(np.pi * np.arange(m := int(10 * half) + 32) / (m - 1))


def shares(scores: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """What each score takes from each node: the row's sum over the nodes' values is the polynomial through them at the score."""
    sign = np.where(np.arange(len(nodes)) % 2, -1.0, 1.0)
    sign[[0, -1]] /= 2
    off = scores[:, None] - nodes
    hit = off == 0
    off[hit] = 1.0
    out = sign / off
    out[hit.any(axis=1)] = 0.0
    out[hit] = 1.0
    return out / out.sum(axis=1, keepdims=True)


def pair_sums(z: np.ndarray, y: np.ndarray, weights: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """A row for each node. Of good texts: what they take from it, times 1, their measures and the products of these. Of bad texts, the chance that one wins against the node's
    score: its sum, and that with their measures; and its slope times 1, measures and products. Rows of parts of the texts add up."""
    i, j = np.triu_indices(MEASURES)
    out = np.zeros((len(nodes), 2 * (1 + MEASURES + len(i)) + 1 + MEASURES))
    for at in range(0, len(z), 1024):
        part, good = z[at : at + 1024], y[at : at + 1024] == 1
        full = np.column_stack([np.ones(len(part)), part, part[:, i] * part[:, j]])
        w, n = full.shape[1], 1 + MEASURES
        out[:, :w] += shares(part[good] @ weights, nodes).T @ full[good]
        p = sigmoid((part[~good] @ weights)[:, None] - nodes)
        out[:, w : w + n] += p.T @ full[~good, :n]
        out[:, w + n :] += (p * (1 - p)).T @ full[~good]
    return out


def pair_step(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the sum over all pairs of the logarithm of the chance that the good text wins."""
    n, w = 1 + MEASURES, 1 + MEASURES + MEASURES * (MEASURES + 1) // 2
    good, won, slope = sums[:, :w], sums[:, w : w + n], sums[:, w + n :]
    gradient = won[:, 0] @ good[:, 1:n] - good[:, 0] @ won[:, 1:]
    square, (i, j) = np.zeros((MEASURES, MEASURES)), np.triu_indices(MEASURES)
    square[i, j] = slope[:, 0] @ good[:, n:] + good[:, 0] @ slope[:, n:]
    cross = good[:, 1:n].T @ slope[:, 1:n]
    return gradient, square + np.triu(square, 1).T - cross - cross.T


def _each(table: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``fn(x, y)``, a matrix, over the rows of ``table(x, y)``; each task sends the sum of its own, and rows of the matrix are added in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                out = fn(x, np.asarray(batch.column(1)))
                total = out if total is None else total + out
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["k", "v"])

    def add(rows: pa.Table) -> pa.Table:
        k, v = np.asarray(rows.column(0)), np.stack(rows.column(1).to_numpy())
        names = np.unique(k)
        return pa.table({"k": names, "v": pa.array([v[k == n].sum(axis=0) for n in names], pa.list_(pa.float64()))})

    parts = table.select("x", "y").mapInArrow(run, "k long, v array<double>")
    rows = parts.groupBy((F.col("k") % 16).alias("g")).applyInArrow(add, "k long, v array<double>").collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["k"])])


def labelled(measured: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``x, y``: the measures and label of every labelled text that may be learned from. An id with several labels counts with the largest; of rows with one id the text
    with the least hash; null ids, labels and texts take no part."""
    known = labels.select(F.col("doc_id").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    known = known.where(~held_out("k")).groupBy("k").agg(F.max("y").alias("y"))
    found = measured.where("h is not null").join(known, F.col("doc_id") == F.col("k")).groupBy("k").agg(F.min_by(F.struct("x", "y"), "h").alias("r"))
    return materialize(found.select("r.x", "r.y"), "labelled")


def fit_pairs(table: DataFrame, *, bad_share: float | None = None, pairs_each: int = 20, ridge: float = 5.0, rounds: int = 30) -> Ranking:
    """Learn from all pairs of ``table(x, y)``. ``bad_share``: the share of bad texts among all labelled ones."""
    first = _each(table, lambda x, y: np.array([[len(y), y.sum(), *x.sum(axis=0), *(x * x).sum(axis=0)]]))
    if not len(first):
        return Ranking(np.zeros(MEASURES), np.ones(MEASURES), np.zeros(MEASURES), 0.0, 0.0)
    n, good = first[0, :2]
    bad, centre = n - good, first[0, 2 : 2 + MEASURES] / n
    scale = np.sqrt(np.maximum(first[0, 2 + MEASURES :] / n - centre * centre, 0.0)) + 1e-6
    if not good or not bad:
        return Ranking(centre, scale, np.zeros(MEASURES), 0.0, 0.0)
    z = lambda x: np.clip((x - centre) / scale, -8, 8)
    weights, each = np.zeros(MEASURES), min(pairs_each, good) / good
    for _ in range(rounds):
        raw = _scores(table, centre, scale, weights).agg(F.min("raw"), F.max("raw")).first()
        nodes = nodes_of(*raw)
        gradient, curve = pair_step(_each(table, lambda x, y, w=weights, t=nodes: pair_sums(z(x), y, w, t)))
        step = np.linalg.solve(each * curve + ridge * np.eye(MEASURES), each * gradient - ridge * weights)
        size = np.abs(step).max()
        weights = weights + step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    share = bad / n if bad_share is None else bad_share
    scored = materialize(_scores(table, centre, scale, weights), "scores")
    weight = {1: (1 - share) / good, 0: share / bad}
    cut = _cut(scored, weight, share)
    return Ranking(centre, scale, weights, cut, max(_slope(scored, {y: w * n for y, w in weight.items()}, cut), 1e-3))


def _scores(table: DataFrame, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> DataFrame:
    model = Ranking(centre, scale, weights, 0.0, 0.0)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(model.raw(np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1))), batch.column(1)], names=["raw", "y"])

    return map_batches(table.select("x", "y"), run, "raw double, y int")


def _cut(scored: DataFrame, weight: dict[int, float], share: float, *, few: int = 10_000, bins: int = 1024) -> float:
    """The middle between the score at which the weights from below reach ``share`` and the next lower one. The bin it lies in is divided until few scores are left."""
    low, high = scored.agg(F.min("raw"), F.max("raw")).first()
    total, below = sum(weight[r["y"]] * r["n"] for r in scored.groupBy("y").agg(F.count("*").alias("n")).collect()), 0.0
    inside = scored
    while low < high and inside.count() > few:
        width = (high - low) / bins
        at = F.least(F.floor((F.col("raw") - low) / width), F.lit(bins - 1)).cast("int") if width > 0 else F.lit(0)
        held = inside.groupBy(at.alias("b")).agg(*[F.sum((F.col("y") == y).cast("long")).alias(f"n{y}") for y in (0, 1)], F.min("raw").alias("low"), F.max("raw").alias("high")).orderBy("b").collect()
        for r in held:
            more = weight[0] * r["n0"] + weight[1] * r["n1"]
            if below + more >= share * total or r is held[-1]:
                break
            below += more
        low, high = r["low"], r["high"]
        inside = scored.where((F.col("raw") >= low) & (F.col("raw") <= high))
    under = scored.where(F.col("raw") < low).agg(F.max("raw")).first()[0]
    if low == high:  # all of one score: the first of them reaches the share only if nothing below does
        own = inside.groupBy("y").count().collect()
        least = min(weight[r["y"]] for r in own)
        return low if under is None or below + least < share * total else (low + under) / 2
    rows = sorted((r["raw"], r["y"]) for r in inside.collect())
    reached = (below + np.cumsum([weight[y] for _, y in rows])) / total
    k = min(int(np.searchsorted(reached, share)), len(rows) - 1)
    before = rows[k - 1][0] if k else rows[0][0] if under is None else under
    return float((rows[k][0] + before) / 2)


def _slope(scored: DataFrame, weight: dict[int, float], cut: float, *, ridge: float = 1e-3, rounds: int = 30) -> float:
    """The slope of the logistic fit of the labels to the scores beyond the cut, with an intercept."""
    v, w, beta = F.col("raw") - cut, F.when(F.col("y") == 1, F.lit(weight[1])).otherwise(F.lit(weight[0])), np.zeros(2)
    for _ in range(rounds):
        p = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), v * float(beta[0]) + float(beta[1])))))
        g, h = w * (F.col("y") - p), w * p * (1.0 - p)
        r = scored.agg(F.sum(g * v), F.sum(g), F.sum(h * v * v), F.sum(h * v), F.sum(h)).first()
        penalty = np.array([ridge, 1e-6])
        step = np.linalg.solve(np.array([[r[2], r[3]], [r[3], r[4]]]) + np.diag(penalty), np.array([r[0], r[1]]) - penalty * beta)
        size = np.abs(step).max()
        beta = beta + step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return float(beta[0])


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, h, x``: the measures of every text and its hash, null for a null text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pa.array([measures(t) for t in bytes_of(batch.column(3))], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], x], names=["doc_id", "held_out", "h", "x"])

    h = F.when(F.col(text_col).isNotNull(), F.xxhash64(F.col(text_col).cast("binary"))).alias("h")
    source = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), h, empty_if_null(text_col).cast("binary").alias("t"))
    return map_batches(source, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, h long, x array<double>")


def _fit(table: DataFrame, labels: DataFrame, label: str) -> Ranking:
    sizes = labels.where(~held_out("doc_id")).agg(F.avg((F.col(label) == 0).cast("double")).alias("bad")).first()
    return fit_pairs(labelled(table, labels, label), bad_share=sizes["bad"])


def fit_from(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Ranking:
    """Fit on all labelled texts that may be learned from."""
    return _fit(measured(docs.where(~held_out(id_col)), id_col=id_col, text_col=text_col), labels, label)


def learned_scores(docs: DataFrame, labels: DataFrame, *, label: str = "quality") -> DataFrame:
    """``quality_scores`` by a ranking learned from the same texts, whose measures are taken once and kept in the shared folder."""
    table = materialize(measured(docs), "measures")
    ranking = _fit(table, labels, label)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = ranking.score(np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_batches(table.select("doc_id", "held_out", "x"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, ranking: Ranking, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = ranking.score(np.array([measures(t) for t in bytes_of(batch.column(2))]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), empty_if_null(text_col).cast("binary").alias("t"))
    return map_batches(source, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")
