"""SimHash near-duplicates by segment popcounts.

A fingerprint's 64 bits are 32 segments of two bits. The number of ones in each segment embeds it in a grid of 32 axes; one
differing bit moves a fingerprint by at most one step along one axis, so the Manhattan distance of two grid points never exceeds
the Hamming distance of their fingerprints. Fingerprints within ``radius`` <= 3 bits are therefore within 3 steps, and within one
step on the first 16 axes or on the last 16. For each half a fingerprint is listed at its grid point and asks at that point and at
the points one step up each axis: a join on equal grid points finds every pair within one step, each once, and the Hamming
distance is then compared exactly.

Copies share a fingerprint and enter once. A grid point at which more than ``crowd`` pairs would meet is not joined. Fingerprints
that touch such a point are linked exactly and linearly instead: two fingerprints within ``radius`` share a neighbour within
ceil(radius / 2) bits, so those that list the same neighbour are candidates; for radius 2 every one of them is a link, and each
group is tied to its smallest member.

Defined cases: a text without words has fingerprint zero and is linked like any other; a null text is empty; a text of fewer words
than a shingle is one shingle; repeated rows and copies fall into one component; a null id takes part, and a component's id is the
smallest id that is not null; ids may have any type that has an order; an empty table gives an empty result; other columns are not read. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import bytes_of, discard, empty_if_null, fresh, id_type, map_batches, materialize, slices

SEED = 42
#: Shingles are counted in so many buckets, to put the frequent ones last.
BUCKETS = 1 << 18


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, joined by spaces; of all words if there are fewer."""
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]][:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned SimHash of a text's word shingles, repeats included."""
    words = text.lower().split()
    return majority(shingle_hashes(words, shingle)) if words else 0


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t, shingle) for t in bytes_of(batch.column(1))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(text_col).cast("binary").alias("t"))
    return map_batches(source, run, f"doc_id {id_type(docs, id_col)}, fp long")


def segment_counts(bits: Column) -> Column:
    """The number of ones in each two-bit segment of 32 bits, in the segment's own place."""
    return bits - F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(0x55555555).cast("long"))


def _half_points(fp: Column, half: int) -> tuple[Column, Column]:
    """A half's grid point, and the grid points one step up each of its axes that is not at its end."""
    point = segment_counts(fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) if half == 0 else F.shiftrightunsigned(fp, 32))
    axes = F.sequence(F.lit(0), F.lit(15))
    up = F.transform(
        F.filter(axes, lambda i: F.call_function("getbit", point, i * 2 + 1) == 0),
        lambda i: point + F.call_function("shiftleft", F.lit(1).cast("long"), i * 2),
    )
    tag = F.lit(half).cast("long") * (1 << 32)
    return point + tag, F.transform(up, lambda x: x + tag)


def links(fps: DataFrame, *, radius: int = 2, crowd: int = 1024) -> DataFrame:
    """``a, b``: pairs of the distinct fingerprints ``fps(fp)`` within ``radius`` bits that connect all such pairs: every pair
    itself, except that fingerprints at crowded grid points are tied to the smallest of those with a common neighbour."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    lists = []
    for half in (0, 1):
        own, up = _half_points(F.col("fp"), half)
        lists.append(F.array(F.struct(own.alias("point"), F.lit(True).alias("own"))))
        lists.append(F.transform(up, lambda p: F.struct(p.alias("point"), F.lit(False).alias("own"))))
    spread = fps.select("fp", F.explode(F.concat(*lists)).alias("x")).select("fp", "x.point", "x.own")
    sizes = spread.groupBy("point").agg(F.sum(F.col("own").cast("long")).alias("owns"), F.count("*").alias("n"))
    # Most grid points have one owner and nobody else who asks for it: they take no part.
    met = materialize(sizes.where("owns > 0 and n > 1").select("point", (F.col("owns") * F.col("n") > crowd).alias("crowded")), "points")
    placed = materialize(spread.join(met.hint("merge"), "point"), "placed")
    calm = placed.where("not crowded")
    owners, askers = calm.where("own").select("point", F.col("fp").alias("a")), calm.select("point", F.col("fp").alias("b"), F.col("own").alias("same"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = owners.join(askers.hint("merge"), (owners["point"] == askers["point"]) & (apart <= radius) & (F.col("a") != F.col("b")) & (~F.col("same") | (F.col("a") < F.col("b")))).select("a", "b")
    crowded = placed.where("crowded").select("fp").distinct()
    return pairs.union(_crowded_links(crowded, radius))


def _crowded_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links among fingerprints by shared neighbours within ceil(radius / 2) bits, each group tied to its smallest member.

    For radius 2 and 1 a shared neighbour one bit off puts two fingerprints within 2; radius 1 and 3 need the exact test, so they
    take the smallest member on either side of each flipped bit.
    """
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    if radius == 2:
        near = fps.select("fp", F.explode(F.concat(F.array(F.col("fp")), F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m)))).alias("near"))
        tied = near.groupBy("near").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most").select("near", "least")
        return near.join(tied.hint("merge"), "near").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    if radius == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    one = fps.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("near"))
    direct = one.join(fps.withColumnRenamed("fp", "near").hint("merge"), "near", "left_semi").select(F.col("fp").alias("a"), F.col("near").alias("b"))
    if radius == 1:
        return direct
    # radius 3: within 2 as above; then neighbours one bit off that are themselves one bit from another's neighbour
    two = _crowded_links(fps, 2)
    ball = one.groupBy("near").agg(F.min("fp").alias("least"))
    across = ball.select("least", F.explode(F.transform(flips, lambda m: F.col("near").bitwiseXOR(m))).alias("near")).join(ball.select("near", F.col("least").alias("other")).hint("merge"), "near").where("least <> other").select(F.col("least").alias("a"), F.col("other").alias("b"))
    return two.union(across.distinct())


def distinct_shingles(text: bytes, shingle: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; none for a text without words."""
    words = text.lower().split()
    return np.unique(shingle_hashes(words, shingle)) if words else np.zeros(0, dtype="<u8")


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a set of shingles."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def prefix_length(size: int, least: float) -> int:
    """How many of a set's rarest shingles are listed: two sets of similarity ``least`` or more share one of them."""
    return size - math.ceil(least * size - 1e-9) + 1 if size else 0


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``place, t``: the text, and 128 bits of id and text by which it is found again."""
    text, name = empty_if_null(text_col), F.col(id_col).cast("string")
    return docs.select(F.struct(F.xxhash64(text, name).alias("one"), F.xxhash64(F.lit("row"), name, text).alias("two")).alias("place"), text.cast("binary").alias("t"))


def fingerprints_and_counts(docs: DataFrame, *, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, sid, bucket, n``: each row's fingerprint and set key, and, in rows with a ``bucket``, how many texts of a task hold
    shingles of each of ``BUCKETS`` buckets."""
    names = ["doc_id", "fp", "sid", "bucket", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = np.zeros(BUCKETS, dtype=np.int64), None
        for batch in slices(batches):
            prints, keys = [], []
            for t in bytes_of(batch.column(1)):
                words = t.lower().split()
                hashes = shingle_hashes(words, shingle) if words else np.zeros(0, dtype="<u8")
                kinds = np.unique(hashes)
                prints.append(majority(hashes) if words else 0)
                keys.append(set_key(kinds))
                np.add.at(held, (kinds % np.uint64(BUCKETS)).astype(np.int64), 1)
            kind = batch.column(0).type
            none = [pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.int64()), *none], names=names)
        at = np.flatnonzero(held)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), kind), *[pa.nulls(len(at), pa.int64())] * 2, pa.array(at.astype(np.int32)), pa.array(held[at])], names=names)

    source = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(text_col).cast("binary").alias("t"))
    return source.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, fp long, sid long, bucket int, n long")


def frequent_buckets(counts: DataFrame) -> np.ndarray:
    """The count of each bucket that stands out from chance, 0 for the others. Any order of shingles keeps the prefix filter exact; this
    one puts shingles of frequent passages last."""
    summed = materialize(counts.groupBy("bucket").agg(F.sum("n").alias("n")), "buckets")
    mean = (summed.agg(F.sum("n")).first()[0] or 0) / BUCKETS
    rank = np.zeros(BUCKETS, dtype=np.int64)
    for r in summed.where(F.col("n") > mean + 6 * math.sqrt(mean) + 1).toLocalIterator():
        rank[r["bucket"]] = r["n"]
    return rank


def parity(shingles: np.ndarray, bins: int = 128) -> np.ndarray:
    """A set's shingles dealt into bins (a power of two), and whether each bin holds an odd number: signed longs. Two sets' parities differ in at
    most as many bits as the sets have elements that only one of them holds."""
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (bins - 1), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def long_parity(shingles: np.ndarray) -> np.ndarray:
    """A parity of at least twice as many bins as the set has elements."""
    return parity(shingles, 1 << max(6, int(2 * len(shingles) - 1).bit_length() if len(shingles) else 6))


def prefixes(docs: DataFrame, rank: np.ndarray, *, shingle: int, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``sid, place, size, p0, p1, long, prefix``: for each distinct set of shingles one text that has it, its size, its parities and its
    rarest shingles in order."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes, odd, wide, firsts = [], [], [], [], []
        for t in bytes_of(batch.column(1)):
            kinds = distinct_shingles(t, shingle)
            order = np.lexsort((kinds, rank[(kinds % np.uint64(BUCKETS)).astype(np.int64)]))
            keys.append(set_key(kinds))
            sizes.append(len(kinds))
            odd.append(parity(kinds).tolist())
            wide.append(long_parity(kinds))
            firsts.append(kinds[order[: prefix_length(len(kinds), least)]].view(np.int64))
        bits = [pa.array([o[k] for o in odd], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0), pa.array(sizes, pa.int32()), *bits, *(pa.array(x, pa.list_(pa.int64())) for x in (wide, firsts))], names=["sid", "place", "size", "p0", "p1", "long", "prefix"])

    found = map_batches(_located(docs, id_col, text_col).select("place", "t"), run, "sid long, place struct<one:long,two:long>, size int, p0 long, p1 long, long array<long>, prefix array<long>")
    same = [F.first(c).alias(c) for c in ("size", "p0", "p1", "long", "prefix")]
    return found.where("size > 0").groupBy("sid").agg(F.min("place").alias("place"), *same)


def _may_be_similar(least: float) -> Column:
    """Whether ``x`` and ``y``, which have met under a listed shingle, may have the similarity. Three exact bounds: on the sizes; on what
    two sets can share if this shingle, at places ``at`` of their lists, is the first that they share (a similar pair also meets under
    its first one); and on the elements that only one of them holds, by their parities."""
    x, y = F.col("x.size"), F.col("y.size")
    common, apart = (x + y) * (least / (1 + least)) - 1e-6, (x + y) * ((1 - least) / (1 + least)) + 1e-6
    odd = F.bit_count(F.col("x.p0").bitwiseXOR(F.col("y.p0"))) + F.bit_count(F.col("x.p1").bitwiseXOR(F.col("y.p1")))
    return (F.least(x, y) >= F.greatest(x, y) * least - 1e-6) & (F.least(x - F.col("x.at"), y - F.col("y.at")) >= common) & (odd <= apart)


def _close(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those pairs whose long parities allow the similarity: an exact bound that leaves little else than similar pairs. The longer of two
    parities is folded to the other's length; sizes that allow the similarity make them differ by one step at most."""
    one, two = (sets.select(F.col("sid").alias(k), F.col("size").alias(f"n{k}"), F.col("long").alias(f"u{k}")) for k in "pq")

    def folded(own: str, other: str) -> Column:
        half = F.floor(F.size(own) / 2).cast("int")
        fold = F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(own) > F.size(other), fold).otherwise(F.col(own))

    odd = F.aggregate(F.zip_with(folded("up", "uq"), folded("uq", "up"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    apart = (F.col("np") + F.col("nq")) * ((1 - least) / (1 + least)) + 1e-6
    return pairs.join(one.hint("merge"), "p").join(two.hint("merge"), "q").where(odd <= apart).select("p", "a", "q", "b")


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, *, shingle: int, least: float, few: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a, b``: the components of either side of those pairs ``p, a, q, b`` (set, its component) whose sets have the similarity,
    compared exactly. Texts are looked up by a broadcast of their places if those are at most ``few``, else by a shuffle."""
    pairs = materialize(_close(pairs, sets, least), "close")
    wanted = pairs.select(F.col("p").alias("sid")).union(pairs.select("q")).distinct()
    wanted = materialize(sets.select("sid", "place").join(wanted.hint("merge"), "sid").select("place", "sid"), "wanted")
    small = wanted.limit(few + 1).count() <= few
    texts = _located(docs, id_col, text_col).join(F.broadcast(wanted) if small else wanted.hint("shuffle_hash"), "place").select("sid", "t")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            found = [distinct_shingles(t, shingle) for t in bytes_of(batch.column(1))]
            good = pa.array([set_key(x) == k for x, k in zip(found, batch.column(0).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["sid", "bag"]).filter(good)

    bags = texts.mapInArrow(shingles, "sid long, bag array<long>").groupBy("sid").agg(F.first("bag").alias("bag"))
    # Both sides of a pair read the same exchange of bags.
    one, two = bags.select(F.col("sid").alias("p"), F.col("bag").alias("s")), bags.select(F.col("sid").alias("q"), F.col("bag").alias("t"))
    both = pairs.join(one.hint("merge"), "p").join(two.hint("merge"), "q")
    common = both.select("a", "b", (F.size("s") + F.size("t")).alias("n"), F.size(F.array_intersect("s", "t")).alias("both"))
    found = materialize(common.where(F.col("both") / (F.col("n") - F.col("both")) >= least).select("a", "b").distinct(), "verified")
    discard(wanted, pairs)
    return found


def _shared(listed: DataFrame) -> DataFrame:
    """``s``: the shingles listed by sets ``(c, s)`` of several components."""
    return listed.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("s")


def _merged(named: DataFrame, edges: DataFrame) -> DataFrame:
    """``sid, c``: every set with its component's name after joining components ``c`` by ``edges``."""
    groups = components(edges).select(F.col("node").alias("c"), F.col("component").alias("now"))
    return materialize(named.join(groups.hint("merge"), "c", "left").select("sid", F.coalesce("now", "c").alias("c")), "set-components")


def similar_groups(docs: DataFrame, held: DataFrame, edges: DataFrame, *, shingle: int, least: float, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``node, component`` of fingerprints that are linked by ``edges``, by equal sets of shingles or by a similarity of at least
    ``least``, all such pairs counted.

    A 64-bit fingerprint cannot tell similarity 0.8 (some ten differing bits) from chance within a radius that a grid can search, so
    an exact prefix filter finds the pairs: equal sets are one; each distinct set lists its ``prefix_length`` rarest shingles, and
    sets that share none of those cannot be similar. Sizes, places in the lists and parities rule out more
    (``_may_be_similar``); the rest is compared.

    Only components are asked for. In each of ``rounds`` rounds every component compares one pair: of its sets that meet, under some
    shingle, the set that lists this shingle foremost, the pair with the closest parities. That joins large groups of copies. Then
    all pairs that are not yet in one component are met, with the sets outside a shingle's largest component on the left: those
    within it need no comparison. Shingles whose sets are all in one component are left out.
    """
    more = {"shingle": shingle, "least": least, "id_col": id_col, "text_col": text_col}
    nodes = materialize(held.where("bucket is null").groupBy("sid").agg(F.min("fp").alias("node")), "nodes")
    equal = held.where("bucket is null").select("sid", "fp").distinct().join(nodes.hint("merge"), "sid").where("fp <> node").select(F.col("node").alias("a"), F.col("fp").alias("b"))
    groups = materialize(components(edges.union(equal)), "first-groups")
    named = materialize(nodes.join(groups.hint("merge"), "node", "left").select("sid", F.coalesce("component", "node").alias("c")), "set-components")
    sets = materialize(prefixes(docs, frequent_buckets(held.where("bucket is not null")), **more), "sets")
    facts = sets.select("sid", "size", "p0", "p1")
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(1 / least) + 1e-9).cast("int")
    listed = sets.select("sid", F.posexplode("prefix").alias("at", "s"))
    live = materialize(_shared(sets.select("sid", "prefix").join(named.hint("merge"), "sid").select("c", F.explode("prefix").alias("s"))), "live")
    posts = materialize(listed.join(live.hint("merge"), "s").join(facts.hint("merge"), "sid").select("s", band.alias("band"), "at", "size", "sid", "p0", "p1"), "posts")
    discard(live)
    pair = (F.col("x.sid").alias("p"), F.col("x.c").alias("a"), F.col("y.sid").alias("q"), F.col("y.c").alias("b"))
    odd = F.bit_count(F.col("x.p0").bitwiseXOR(F.col("y.p0"))) + F.bit_count(F.col("x.p1").bitwiseXOR(F.col("y.p1")))
    for k in range(rounds + 1):
        told = materialize(posts.join(named.hint("merge"), "sid").select("s", "band", F.struct("at", "size", "sid", "c", "p0", "p1").alias("x")), "told")
        live = materialize(_shared(told.select("s", "x.c")), "live")
        if k < rounds:
            # The set that lists a shingle foremost, of those whose shingles are in several components.
            leads = materialize(told.groupBy("s", "band").agg(F.min("x").alias("y")).join(live.hint("merge"), "s"), "leads")
            met = told.join(leads.hint("merge"), ["s", "band"]).where((F.col("x.c") != F.col("y.c")) & _may_be_similar(least))
            best = met.groupBy("x.c").agg(F.min(F.struct(odd.alias("odd"), F.struct(*pair).alias("pair"))).alias("best")).select("best.pair.*")
        else:
            sizes = told.join(live.hint("merge"), "s").groupBy("s", F.col("x.c").alias("c")).agg(F.count("*").alias("n"))
            leads = materialize(sizes.groupBy("s").agg(F.max(F.struct("n", "c")).alias("top")).select("s", F.col("top.c").alias("top")), "largest")
            split = told.join(leads.hint("merge"), "s").select("s", "band", "x", (F.col("x.c") == F.col("top")).alias("main"))
            left = split.where("not main").select("s", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "x")
            met = left.join(split.select("s", "band", F.col("x").alias("y"), "main").hint("merge"), ["s", "band"])
            best = met.where((F.col("x.c") != F.col("y.c")) & (F.col("main") | (F.col("x.sid") < F.col("y.sid"))) & _may_be_similar(least)).select(*pair).distinct()
        pairs = materialize(best, "pairs")
        found = verified(docs, pairs, sets, **more)
        old, named = named, _merged(named, found)
        discard(told, live, leads, pairs, found, old)
    discard(posts, sets)
    # The sets' components, handed to all fingerprints of the first groups.
    moved = nodes.join(named.hint("merge"), "sid").join(groups.hint("merge"), "node", "left").select(F.coalesce("component", "node").alias("component"), "c").distinct()
    every = groups.select("node", "component").union(nodes.select("node").distinct().join(groups.hint("merge"), "node", "left_anti").select("node", F.col("node").alias("component")))
    return every.join(moved.hint("merge"), "component", "left").select("node", F.coalesce("c", "component").alias("component"))


def near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = 2, least_similarity: float | None = None, crowd: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row: fingerprints within ``radius`` bits are linked, and with ``least_similarity`` all
    whose texts have that similarity (``similar_groups``); a component is named by its smallest id."""
    if least_similarity is None:
        held = materialize(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "fingerprints")
        rows = held
    else:
        held = materialize(fingerprints_and_counts(docs, shingle=shingle, id_col=id_col, text_col=text_col), "fingerprints")
        rows = held.where("bucket is null")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    edges = links(classes.select("fp"), radius=radius, crowd=crowd)
    if least_similarity is None:
        found = components(edges)
    else:
        found = similar_groups(docs, held, edges, shingle=shingle, least=least_similarity, id_col=id_col, text_col=text_col)
    groups = found.select(F.col("node").alias("fp"), F.col("component").alias("group"))
    named = materialize(classes.join(groups.hint("merge"), "fp", "left").select("fp", "rep", F.coalesce("group", "fp").alias("group")), "groups")
    least = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    names = materialize(named.join(least.hint("merge"), "group").select("fp", "component_id"), "named")
    return rows.select("doc_id", "fp").join(names.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, *, shingle: int = 5, radius: int = 2, least_similarity: float | None = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that name their component, with all their columns. Of equal ids all rows stay, as they share one name;
    so do rows without an id, which no other row can stand for."""
    found = near_duplicates(docs, shingle=shingle, radius=radius, least_similarity=least_similarity, id_col=id_col, text_col=text_col)
    leader = fresh(docs, "leader")
    leaders = found.where("doc_id = component_id").select(F.col("doc_id").alias(leader)).distinct()
    kept = docs.join(leaders.hint("shuffle_hash"), F.col(id_col) == F.col(leader), "left_semi")
    return kept.union(docs.where(F.col(id_col).isNull()))
