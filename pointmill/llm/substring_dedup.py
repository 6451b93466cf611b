"""Removal of byte strings that occur more than once, by a distributed prefix-free parse.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else in the corpus.

* *Parse.* A rolling hash of every ``GRAM`` bytes picks triggers: in each string of ``length`` bytes the gram with the least hash
  (the first of equals) is its trigger, so equal strings have equal triggers at equal offsets. A phrase is what the strings of one
  trigger cover together; neighbouring phrases overlap by length - 1 bytes, and every string of ``length`` bytes lies in exactly
  one phrase. A text is the sequence of its phrases, each given by the hashes of its trigger and of its content.
* *Dictionary.* Triggers that occur once belong to strings that occur once, and are done with. A phrase that occurs twice is
  removed whole. What remains, the distinct phrases of repeated triggers with differing content (the ends of repeated passages),
  is the dictionary whose suffixes must be told apart. How often a phrase occurs in the parse is the weight of its suffixes.
* *Suffixes.* Every suffix of the corpus begins with a dictionary suffix of at least ``length`` bytes. Suffixes are named in two
  steps, longer common parts first, as parallel suffix sorting by naming does. A *strip* is ``STRIP`` neighbouring suffixes at fixed
  distances from their trigger; what all of them share is the strip's core, named by a hash, and what its suffixes have beyond the
  core is at most ``STRIP`` - 1 bytes on either side. Strips with a core that occurs once hold no repeated string; equal strips
  that occur twice hold nothing else; only in the others are single suffixes compared, by the bytes beyond the core.

Everything after the parse is a hash aggregate or a join, so a trigger, core or string that a large share of the corpus holds is
combined before it is dealt out; there is one way for all sizes. Only equality is asked for, so names stand in for ranks and no
suffix array is sorted.

A phrase is named by 128 bits (hashes of trigger and content), a core by 128 bits (hashes of trigger and core), a row by 128 bits of
its id and text.

Defined cases: a null text is empty; a text shorter than ``length`` loses nothing; copies and repeated rows lose everything if they
are at least that long; a null id is a row like any other, and ids may have any type; an empty table gives an empty result; other
columns are not read. Texts of any length are parsed in blocks with ``length`` - 1 bytes of overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, discard, empty_if_null, id_type, map_batches, materialize

LENGTH, GRAM, BLOCK, STRIP = 200, 24, 1 << 20, 16
_ODD = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(7).integers(1 << 62, (1 << 63) - 1, 256, dtype=np.int64).astype(np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = [np.full(max(n, 1 << 16), x, dtype=np.uint64) for x in (_ODD, pow(_ODD, -1, 1 << 64))]
        _POWERS.clear()
        for b in base:
            b[0] = 1
            _POWERS.append(np.cumprod(b, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Hashes of any substring of a byte string, in constant time each."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[raw] * up[: len(raw)], out=self.sums[1:], dtype=np.uint64)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def parse(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """The phrases of a text: first string, number of strings, trigger's offset in the phrase, hashes of trigger and of content."""
    out: list[tuple[np.ndarray, ...]] = []
    total = len(text) - length + 1
    whole = np.frombuffer(text, dtype=np.uint8)
    for begin in range(0, max(total, 0), BLOCK):
        raw = whole[begin : min(begin + BLOCK, total) + length - 1]
        hashes = Rolling(raw)
        grams = hashes.every(GRAM)
        least = _sliding_least((grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
        trigger = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
        count = np.diff(np.r_[first, len(trigger)])
        at = trigger[first]
        offset = at - first
        content = hashes.of(first, first + count + length - 1)
        content = _mix(content ^ (offset.astype(np.uint64) << np.uint64(32)) ^ count.astype(np.uint64))
        out.append((first + begin, count, offset, grams[at].view(np.int64), content.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, dtype=np.int64) for _ in range(5))


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, k1, k2, t``: rows told apart by 128 bits of their id and text."""
    text, name = empty_if_null(text_col), F.col(id_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text, name).alias("k1"), F.xxhash64(F.lit("row"), name, text).alias("k2"), text.cast("binary").alias("t"))


def _parsed(rows: DataFrame, length: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [parse(t, length) for t in bytes_of(batch.column(2))]
        of = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
        first, count, offset, gram, phrase = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(of), batch.column(1).take(of), *(pa.array(x.astype(np.int32)) for x in (first, count, offset)), pa.array(gram), pa.array(phrase)],
            names=["k1", "k2", "first", "count", "offset", "gram", "phrase"],
        )

    return map_batches(rows.select("k1", "k2", "t").where(F.octet_length("t") >= length), run, "k1 long, k2 long, first int, count int, offset int, gram long, phrase long")


def strips(text: bytes, first: np.ndarray, count: np.ndarray, offset: np.ndarray, length: int = LENGTH) -> tuple:
    """The strips of some phrases of a text: phrase's number, strip's number, hash of its core, least and greatest distance of its
    suffixes from the trigger, and the bytes of the text before and after the core that its suffixes reach."""
    low, high = offset - count + 1, offset
    many = high // STRIP - low // STRIP + 1
    of = np.repeat(np.arange(len(first)), many)
    strip = low[of] // STRIP + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    lo, hi = np.maximum(low[of], strip * STRIP), np.minimum(high[of], strip * STRIP + STRIP - 1)
    trigger = (first + offset)[of]
    begin = trigger - strip * STRIP
    end = begin + length - STRIP + 1
    core = np.zeros(len(of), dtype=np.uint64)
    block = begin // BLOCK
    for k in np.unique(block):
        own = block == k
        raw = np.frombuffer(text, dtype=np.uint8)[k * BLOCK : int(end[own].max())]
        core[own] = Rolling(raw).of(begin[own] - k * BLOCK, end[own] - k * BLOCK)
    left = [text[a:b] for a, b in zip((trigger - hi).tolist(), begin.tolist(), strict=True)]
    right = [text[a:b] for a, b in zip(end.tolist(), (trigger - lo + length).tolist(), strict=True)]
    return of, strip, core.view(np.int64), lo, hi, left, right


def _strips(rows: DataFrame, phrases: DataFrame, length: int) -> DataFrame:
    """The strips of each phrase of the dictionary, read from the text of the row that stands for it. A repeated row reads its phrases
    twice; these occur twice anyway, and more than that makes no difference."""
    wanted = phrases.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "count", "offset", "gram", "phrase", "n")).alias("w"))
    joined = rows.select("k1", "k2", "t").join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("t", "w")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for text, w in zip(bytes_of(batch.column(0)), batch.column(1), strict=True):
            first, count, offset, gram, phrase, n = w.values.flatten()
            of, strip, core, lo, hi, left, right = strips(text, *(np.asarray(x).astype(np.int64) for x in (first, count, offset)), length)
            take = pa.array(of)
            ints = [pa.array(x.astype(np.int32)) for x in (strip, lo, hi)]
            yield pa.RecordBatch.from_arrays(
                [gram.take(take), phrase.take(take), n.take(take), offset.take(take), *ints, pa.array(core), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                names=["gram", "phrase", "n", "offset", "strip", "lo", "hi", "core", "left", "right"],
            )

    return map_batches(joined, run, "gram long, phrase long, n long, offset int, strip int, lo int, hi int, core long, left binary, right binary")


_CORE = ["gram", "strip", "core"]
_STRIP = [*_CORE, "lo", "hi", "left", "right"]


def _repeated_in_dictionary(found: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``gram, phrase, start, number``: the suffixes of phrases of weight 1 that occur elsewhere in the dictionary; and the tables to
    discard after use."""
    # A strip of weight 1 has one phrase, whose name and offset it keeps.
    kinds = materialize(found.groupBy("name", *_STRIP).agg(F.sum("n").alias("weight"), F.min("phrase").alias("phrase"), F.min("offset").alias("offset")), "strip-kinds")
    twice = materialize(kinds.where("weight > 1").select("gram", "name"), "strips-twice")
    equal = found.where("n = 1").select("gram", "name", "phrase", "offset", "lo", "hi").join(twice.hint("merge"), ["gram", "name"]).select("gram", "phrase", (F.col("offset") - F.col("hi")).alias("start"), (F.col("hi") - F.col("lo") + 1).alias("number"))
    unlike = materialize(kinds.groupBy(*_CORE).agg(F.count("*").alias("kinds"), F.min("weight").alias("least")).where("kinds > 1 and least = 1").select(*_CORE), "cores")
    j = F.col("o") - F.col("strip") * STRIP
    single = kinds.join(unlike.hint("merge"), _CORE).select("*", F.explode(F.sequence("lo", "hi")).alias("o"))
    single = single.select(*_CORE, "o", F.concat(F.substring("left", F.octet_length("left") - j + 1, j), F.substring("right", F.lit(1), STRIP - 1 - j)).alias("beyond"), "weight", "phrase", "offset")
    single = materialize(single, "suffixes")
    name = [*_CORE, "o", "beyond"]
    again = materialize(single.groupBy(*name).agg(F.sum("weight").alias("all")).where("all > 1").select(*name), "suffixes-twice")
    return equal.union(single.where("weight = 1").join(again.hint("merge"), name).select("gram", "phrase", (F.col("offset") - F.col("o")).alias("start"), F.lit(1).alias("number"))), [kinds, twice, unlike, single, again]


def removed_spans(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, spans``: for each row that loses something the spans [start, end) of bytes, not yet merged."""
    if length < GRAM + STRIP:
        raise ValueError(f"length must be at least {GRAM + STRIP}")
    rows = _row_key(docs, id_col, text_col)
    parsed = materialize(_parsed(rows, length), "parse")
    # Written first, so that both sides of the join are plain exchanges and a hot trigger's partition can be split.
    twice = materialize(parsed.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "triggers")
    held = materialize(parsed.join(twice.hint("merge"), "gram"), "repeated")
    discard(parsed, twice)
    kinds = materialize(held.groupBy("gram", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "count", "offset")).alias("at")), "phrases")
    forked = materialize(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram"), "forked")
    unlike = kinds.join(forked.hint("merge"), "gram").select("gram", "phrase", "n", "at.*")
    found = materialize(_strips(rows, unlike, length).withColumn("name", F.xxhash64(*_STRIP)), "strips")
    part, used = _repeated_in_dictionary(found)
    part = part.groupBy("gram", "phrase").agg(F.collect_list(F.struct("start", "number")).alias("runs"))
    whole = kinds.where("n > 1").select("gram", "phrase", F.array(F.struct(F.lit(0).alias("start"), F.col("at.count").alias("number"))).alias("runs"))
    runs = materialize(whole.union(part), "runs")
    discard(kinds, forked, found, *used)
    spans = held.join(runs.hint("merge"), ["gram", "phrase"]).select("k1", "k2", F.explode(F.transform("runs", lambda r: F.struct((F.col("first") + r["start"]).alias("start"), (F.col("first") + r["start"] + r["number"] + (length - 1)).alias("end")))).alias("span"))
    # A set: repeated rows lose the same spans.
    spans = materialize(spans.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans")), "spans")
    discard(held, runs)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, removed, kept`` for every row: the merged spans removed and the bytes that remain."""
    found = _with_spans(docs, length, id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [_cut(t, s) for t, s in zip(bytes_of(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([n for n, _, _ in out]), pa.array([sum(b - a for a, b in r) for _, r, _ in out], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in r] for _, r, _ in out], kind), pa.array([k for _, _, k in out], pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "removed", "kept"],
        )

    return map_batches(found, run, f"doc_id {id_type(docs, id_col)}, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary")


def _with_spans(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    spans = removed_spans(docs, length=length, id_col=id_col, text_col=text_col)
    return _row_key(docs, id_col, text_col).join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "t", "spans")


def _cut(text: bytes, spans: list[dict] | None) -> tuple[int, list[tuple[int, int]], bytes]:
    gone = merged([(s["start"], s["end"]) for s in spans or ()])
    edges = [0, *(x for s in gone for x in s), len(text)]
    return len(text), gone, b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def digests(docs: DataFrame, *, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``remove_repeats`` with a digest in place of the spans and bytes: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    found = remove_repeats(docs, length=length, id_col=id_col, text_col=text_col)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

