"""Benchmark decontamination by SimHash over windows the size of a benchmark item.

A document is contaminated by an item if one of its windows, as many words long as the item, has a weighted Jaccard similarity of
at least ``similarity`` with the item on five-word shingles (bags: repeats count). A shingle weighs the more the fewer items hold it.

1. *Weights.* A hash aggregate counts, over the whole benchmark, the items that hold a shingle, in ``BUCKETS`` buckets of shingle
   hashes. A shingle's weight is log(1 + items / count of its bucket); so it depends neither on how items are grouped nor on their
   order, and its table has a fixed size.
2. *Windows.* For each item size, every window of the document with that many words is looked at. What it can share with any item of
   the size is bounded by the weight of its shingles that some such item holds; where this bound, a running sum, reaches the
   similarity, the window is fingerprinted. No other window can match.
3. A window's *SimHash* is the sign of the sum of its shingles' hash bits, by the square roots of their weights: so the angle between similar bags does not
   depend on how the weights are spread (see ``simhash``).
4. *Multi-index Hamming blocks.* Fingerprints are cut into ``BLOCKS`` blocks. If two fingerprints differ in at most ``radius`` bits,
   they differ in at most radius // BLOCKS bits in one of their blocks; every item is listed under each of its blocks, and a window
   looks up, for every block, all values within that many bits of its own, so it meets every item within the radius.
5. Candidates within the radius are compared by exact weighted shingles.

All steps but the radius are exact; similarity 0.8 means a cosine of at least 0.889, so at most 10 differing bits of 64 on average, and 19 or fewer in all but about
one case in a thousand; a window with exactly an item's shingles differs in none.

Items are dealt by a hash into groups of about ``group_bytes`` of text; the documents are read once for each group, and a group is
what a task holds. The groups do not change any similarity.

Words: letters A-Z are lower-cased, then runs of ASCII letters and digits and of non-ASCII characters; punctuation does not count.

Defined cases: null and empty texts hold no windows and null or wordless items match nothing; an item of fewer than five words is
one shingle of all its words; a document shorter than an item is one window; of several windows of a document that match an item the
most similar counts, the first of equals; repeated rows each match, repeated items each match; empty tables give an empty result;
other columns are not read. Texts are read whole.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, empty_if_null, id_type, keep_rows, map_batches
from .substring_dedup import Rolling, _mix

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 19, 5
BUCKETS = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: First bit and width of each block.
_CUTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def shingle_hashes(text: bytes, size: int = SHINGLE) -> tuple[np.ndarray, int]:
    """Hashes of a text's word shingles, in order, and its number of words."""
    raw = np.frombuffer(text, dtype=np.uint8)
    small = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    inside = (small >= 128) | ((small >= 97) & (small <= 122)) | ((small >= 48) & (small <= 57))
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    if not n:
        return np.zeros(0, dtype=np.uint64), 0
    words = Rolling(small.astype(np.uint8)).of(starts, ends)
    span = min(size, n)
    out = np.zeros(n - span + 1, dtype=np.uint64)
    for j in range(span):
        out = out * _STEP + words[j : j + len(out)]
    return _mix(out ^ np.uint64(span)), n


def simhash(hashes: np.ndarray, weights: Weights) -> int:
    """The SimHash of a bag of shingles.

    A shingle votes with the square root of its weight in the bag, so the cosine of two bags is the weight that they share over the geometric mean of their weights,
    whatever the single weights are: at least 2 s / (1 + s) for a similarity s. Shingles that no item holds have no vote; leaving them out only brings a
    window nearer to the items.
    """
    hashes, many = np.unique(hashes, return_counts=True)
    votes = np.sqrt(weights(hashes) * many) * weights.held(hashes)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(votes @ bits * 2 - votes.sum() > 1e-9, bitorder="little").tobytes(), "little")


class Weights:
    """Weights of shingles by the number of items that hold them."""

    def __init__(self, items: int, counts: np.ndarray):
        self.of_bucket = np.log1p(items / np.maximum(1, counts)).astype(np.float32)
        self.in_items = counts > 0

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self.of_bucket[(hashes % np.uint64(BUCKETS)).astype(np.int64)].astype(np.float64)

    def held(self, hashes: np.ndarray) -> np.ndarray:
        """Whether an item may hold a shingle."""
        return self.in_items[(hashes % np.uint64(BUCKETS)).astype(np.int64)]


def weighted_similarity(a: np.ndarray, b: np.ndarray, weights: Weights) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    left, right = Counter(a.tolist()), Counter(b.tolist())
    kinds = sorted(left.keys() | right.keys())
    if not kinds:
        return 0.0
    w = weights(np.array(kinds, dtype=np.uint64))
    pairs = np.array([(left[k], right[k]) for k in kinds])
    return float(w @ pairs.min(axis=1) / (w @ pairs.max(axis=1)))


class ItemIndex:
    """Shingles, fingerprints and Hamming blocks of one group of items."""

    def __init__(self, items: list[tuple[object, str | None]], size: int, radius: int, weights: Weights):
        self.size, self.radius, self.weights = size, radius, weights
        self.ids, self.bags, self.prints = [], [], []
        sizes: list[int] = []
        for item, text in items:
            hashes, n = shingle_hashes((text or "").encode(), size)
            if n:
                self.ids.append(item)
                self.bags.append(hashes)
                self.prints.append(simhash(hashes, weights))
                sizes.append(n)
        #: The items' sizes, the shingles that items of each size hold, and the least weight of an item of the size.
        self.sizes, of = np.unique(sizes, return_inverse=True) if sizes else (np.zeros(0, dtype=np.int64), [])
        self.least = np.full(len(self.sizes), np.inf)
        for k, s in enumerate(of):
            self.least[s] = min(self.least[s], weights(self.bags[k]).sum())
        held = [(h, s) for bag, s in zip(self.bags, of, strict=True) for h in set(bag.tolist())]
        table = np.array(sorted(set(held)), dtype=np.uint64).reshape(-1, 2)
        self.known, begins = np.unique(table[:, 0], return_index=True)
        self.begins, self.of_size = np.r_[begins, len(table)], table[:, 1].astype(np.int64)
        self.short = sorted({int(n) for n in self.sizes if n < size})
        self.blocks: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(BLOCKS)]
        for k, fp in enumerate(self.prints):
            for b, (at, width) in enumerate(_CUTS):
                self.blocks[b][fp >> at & ((1 << width) - 1)].append(k)
        self.flips = {w: [sum(1 << f for f in x) for far in range(radius // BLOCKS + 1) for x in combinations(range(w), far)] for _, w in _CUTS}

    def near(self, fp: int) -> set[int]:
        """All items within the radius of a fingerprint."""
        met: set[int] = set()
        for block, (at, width) in zip(self.blocks, _CUTS, strict=True):
            own = fp >> at & ((1 << width) - 1)
            for flip in self.flips[width]:
                met.update(block.get(own ^ flip, ()))
        return {k for k in met if (fp ^ self.prints[k]).bit_count() <= self.radius}

    def windows(self, own: np.ndarray, n: int, words: int, similarity: float) -> list[tuple[int, int]]:
        """First word and number of words of the windows that may match, for shingles of ``words`` words of a text of ``n`` words."""
        slot = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        at = np.flatnonzero(self.known[slot] == own)
        if not len(at):
            return []
        weight = self.weights(own)
        many = self.begins[slot[at] + 1] - self.begins[slot[at]]
        place = np.repeat(at, many)
        size = self.of_size[np.repeat(self.begins[slot[at]] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(len(place))]
        enough = np.bincount(size, weights=weight[place], minlength=len(self.sizes)) >= similarity * self.least - 1e-9
        total = np.r_[0.0, np.cumsum(weight)]
        out = []
        for s in np.flatnonzero(enough).tolist():
            long = int(self.sizes[s])
            if (words < self.size or long < self.size) and long != words:
                continue
            known = np.zeros(len(own))
            known[place[size == s]] = weight[place[size == s]]
            known = np.r_[0.0, np.cumsum(known)]
            span = min(long, n) - words + 1
            shared, whole = known[span:] - known[:-span], total[span:] - total[:-span]
            may = np.flatnonzero((shared >= similarity * whole - 1e-9) & (shared >= similarity * self.least[s] - 1e-9))
            out += [(b, min(long, n)) for b in may.tolist()]
        return out

    def matches(self, text: bytes, similarity: float) -> list[tuple[object, int, int, float, int]]:
        """Items that a text holds: item, first word, words, similarity, differing bits."""
        if not len(self.known):
            return []
        best: dict[int, tuple[float, int, int, int]] = {}
        for words in (self.size, *self.short):
            own, n = shingle_hashes(text, words)
            # A text of fewer words than a shingle is one shingle of all its words, which only an item of as many words can hold.
            if n < words and n not in self.short or not n:
                continue
            found: dict[int, set[int]] = {}
            for begin, size in self.windows(own, n, min(words, n), similarity):
                part = own[begin : begin + size - min(words, n) + 1]
                fp = simhash(part, self.weights)
                if fp not in found:
                    found[fp] = self.near(fp)
                for k in sorted(found[fp]):
                    s = weighted_similarity(part, self.bags[k], self.weights)
                    if s >= similarity and (k not in best or s > best[k][0] + 1e-12):
                        best[k] = (s, begin, size, (fp ^ self.prints[k]).bit_count())
        return [(self.ids[k], begin, size, s, bits) for k, (s, begin, size, bits) in sorted(best.items())]


def item_weights(benchmark: DataFrame, *, shingle: int = SHINGLE, item_text_col: str = "text") -> Weights:
    """Weights over the whole benchmark: what comes back is one count for each bucket."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, items = np.zeros(BUCKETS, dtype=np.int64), 0
        for text in bytes_of(batch.column(0)):
            hashes, n = shingle_hashes(text, shingle)
            items += n > 0
            counts[np.unique(hashes % np.uint64(BUCKETS)).astype(np.int64)] += 1
        at = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[counts[at], items])], names=["bucket", "n"])

    counts = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in map_batches(benchmark.select(empty_if_null(item_text_col).cast("binary").alias("t")), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["bucket"]] = r["n"]
    return Weights(int(counts[-1]), counts[:-1])


def _groups(benchmark: DataFrame, group_bytes: int, item_col: str, item_text_col: str):
    """The items, one bounded group after the other, in an order of their own."""
    total = benchmark.agg(F.sum(F.octet_length(F.col(item_text_col).cast("string")))).first()[0] or 0
    many = -(-total // group_bytes)
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t is not null")
    for g in range(many):
        own = rows.where(F.pmod(F.xxhash64(F.col("i").cast("string"), "t"), F.lit(many)) == g).collect()
        yield sorted(((r["i"], r["t"]) for r in own), key=lambda x: (str(x[0]), x[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS, group_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, first_word, n_words, similarity, bits``: one row for each document and benchmark item that it holds."""
    schema = f"doc_id {id_type(docs, id_col)}, item_id {id_type(benchmark, item_col)}, first_word long, n_words long, similarity double, bits int"
    source = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(text_col).cast("binary").alias("t"))
    weights = item_weights(benchmark, shingle=shingle, item_text_col=item_text_col)
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _groups(benchmark, group_bytes, item_col, item_text_col):
        held = _Held(items, shingle, radius, weights)

        def run(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            index = held.index()
            rows = [(i, *m) for i, t in enumerate(bytes_of(batch.column(1))) for m in index.matches(t, similarity)]
            of, item, *rest = zip(*rows, strict=True) if rows else ([],) * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(item), *(pa.array(v, k) for v, k in zip(rest, kinds, strict=True))], names=["doc_id", "item_id", "first_word", "n_words", "similarity", "bits"]) if rows else None

        out = out.union(map_batches(source, run, schema))
    return out


class _Held:
    """A group of items as it goes to the tasks; its index is built once in each worker."""

    _built: dict[str, ItemIndex] = {}

    def __init__(self, items: list, shingle: int, radius: int, weights: Weights):
        self.items, self.shingle, self.radius, self.weights, self.key = items, shingle, radius, weights, uuid.uuid4().hex

    def index(self) -> ItemIndex:
        if self.key not in self._built:
            self._built.clear()
            self._built[self.key] = ItemIndex(self.items, self.shingle, self.radius, self.weights)
        return self._built[self.key]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY, text_col: str = "text", group_bytes: int = 8 << 20, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns. No shuffle."""
    at = docs.columns.index(text_col)
    weights = item_weights(benchmark, item_text_col=item_text_col)
    for items in _groups(benchmark, group_bytes, item_col, item_text_col):
        held = _Held(items, SHINGLE, RADIUS, weights)

        def decide(batch: pa.RecordBatch, held=held) -> pa.Array:
            index = held.index()
            return pa.array([not index.matches(t, similarity) for t in bytes_of(batch.column(at))], pa.bool_())

        docs = keep_rows(docs, decide)
    return docs
