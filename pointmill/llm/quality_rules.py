"""Quality rules: counts of repetition and symbols, and the fertility of public tokenisers.

Fertility is how many tokens a vocabulary needs for a text. Prose in a language the vocabulary covers needs few; noise, shouting,
markup and encodings need many, or few kinds. Two public vocabularies, one of pieces with byte fallback and one of bytes, tokenise each
distinct word once. For each text they measure

* ``chars_per_piece`` and ``chars_per_token``: code points of words per token of the one and the other,
* ``byte_share``: the share of pieces that are byte fallbacks,
* ``entropy``: the Shannon entropy (bits) of the text's pieces.

All of them depend on how long a text is, so bands are kept by key (language, or main script for a null or unknown language) and level,
the power of two that the number of pieces reaches. ``fit_bands`` learns them from all good labelled texts that are not held out: the
middle 1 - 2 x ``tail`` of each measure, widened by ``margin`` times the way from its middle to its end. A key and level with fewer than
``least`` such texts has no fitted band; there, and without labels, the fixed limits of ``FIXED`` hold. A text outside its band is
rejected. The quantiles are exact: counts by narrow bins tell which bins hold the wanted ranks, and only the values in these are ranked.

Defined cases: a null text has no words; a text without words has 0 for every measure and fails the base rules; repeated rows are
judged each on its own; an empty table gives an empty result; with no good labels the fixed limits decide; the language is only a key
of the bands, null or unknown falls back to the script. A text of any length is judged whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, discard, empty_if_null, held_out, id_type, keep_rows, map_batches, materialize
from .words import WordPieces, byte_piece_ids, default_path

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30


#: Least and greatest characters per piece, greatest byte share, by script.
FIXED = {"latin": (1.0, 10.0, 0.10), "cyrillic": (0.7, 10.0, 0.10), "other": (0.3, 10.0, 0.60)}


@dataclass(frozen=True)
class Bands:
    """Fitted limits ``(low, high)`` of the four measures by key and level."""

    fitted: dict[tuple[str, int], tuple[tuple[float, ...], tuple[float, ...]]] = field(default_factory=dict)

    @staticmethod
    def level(pieces: int) -> int:
        return max(1, pieces).bit_length() - 1

    def hold(self, lang: str | None, script: str, pieces: int, measures: tuple[float, ...]) -> bool:
        """Whether measures (``chars_per_piece, chars_per_token, byte_share, entropy``) lie inside the band."""
        level = self.level(pieces)
        band = self.fitted.get(((lang or "").lower(), level)) or self.fitted.get((script, level))
        if band is None:
            low, high, most = FIXED[script]
            return low <= measures[0] <= high and measures[2] <= most
        return all(a <= x <= b for a, x, b in zip(band[0], measures, band[1], strict=True))


def script_of(lead: np.ndarray) -> str:
    """The main script, from a text's byte histogram: Latin unless the lead bytes of another make up a third of the characters."""
    chars = max(1, int(lead[:128].sum() + lead[192:].sum() - lead[9:14].sum() - lead[32]))
    if lead[0xD0:0xD4].sum() * 3 > chars:
        return "cyrillic"
    if (lead[0xCC:0xD0].sum() + lead[0xD4:].sum()) * 3 > chars:
        return "other"
    return "latin"


def repeated_window_words(ids: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice. Windows are compared exactly: ids are packed into one
    integer, re-ranked where the bits run out."""
    if len(ids) <= window:
        return 0
    now, width, span = ids.astype(np.int64), 1, max(2, distinct)
    while width < window:
        bits = int(span - 1).bit_length()
        step = next(s for s in (8, 4, 2) if width * s <= window and (s * bits <= 62 or s == 2))
        size = len(now) - width * (step - 1)
        packed = now[:size].copy()
        for j in range(1, step):
            packed = (packed << bits) | now[j * width : j * width + size]
        width *= step
        order = np.sort(packed)
        if not (order[1:] == order[:-1]).any():
            return 0
        if width < window:
            kinds, now = np.unique(packed, return_inverse=True)
            span = len(kinds)
        else:
            now = packed
    _, inverse, counts = np.unique(now, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(texts: list[bytes], langs: list[str | None], table: WordPieces, bands: Bands) -> list[tuple]:
    """The measures of a block of texts, in the order of ``COLUMNS``."""
    split = [x.split() for x in texts]
    n_words = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    numbers = table.numbers([w for words in split for w in words])
    doc = np.repeat(np.arange(len(texts)), n_words)
    sizes, flat = table.pieces(numbers)
    pieces = np.bincount(doc, weights=sizes, minlength=len(texts)).astype(np.int64)
    of_piece = np.repeat(doc, sizes)
    byte_pieces = np.bincount(of_piece[byte_piece_ids(table.piece_path)[flat]], minlength=len(texts))
    keys, counts = np.unique((of_piece << 24) | flat, return_counts=True)
    share = counts / pieces[keys >> 24]
    entropy = np.bincount(keys >> 24, weights=-share * np.log2(share), minlength=len(texts))
    suspects = _texts_with_repeats(numbers, doc)
    tokens = np.bincount(doc, weights=table.tokens[numbers], minlength=len(texts)).astype(np.int64)
    starts = np.r_[0, np.cumsum(n_words)]
    out = []
    for i, text in enumerate(texts):
        lead = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
        chars = int(lead.sum() - lead[0x80:0xC0].sum() - lead[9:14].sum() - lead[32])
        lines = [x for x in text.split(b"\n") if x.strip()]
        n, n_repeat = int(n_words[i]), 0
        if i in suspects:
            kinds, ids = np.unique(numbers[starts[i] : starts[i + 1]], return_inverse=True)
            n_repeat = repeated_window_words(ids, len(kinds))
        base_failed = n < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n
        script = script_of(lead)
        total = max(1, int(pieces[i]))
        found = (chars / total, chars / max(1, int(tokens[i])), float(byte_pieces[i]) / total, float(entropy[i]))
        inside = bands.hold(langs[i], script, int(pieces[i]), found)
        out.append((n, chars, int(lead[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), n_repeat, base_failed, not base_failed and inside, *found, script, int(pieces[i])))
    return out


def _texts_with_repeats(numbers: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> set[int]:
    """Texts in which two windows of words share a hash: a superset of those with a repeated window."""
    if len(numbers) <= window:
        return set()
    size = len(numbers) - window + 1
    h = np.zeros(size, dtype=np.uint64)
    for j in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + numbers[j : j + size].astype(np.uint64) + np.uint64(1)
    inside = doc[:size] == doc[window - 1 :]
    h, at = h[inside] ^ (doc[:size][inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), doc[:size][inside]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    return set(at[order[1:][same]].tolist()) | set(at[order[:-1][same]].tolist())


COLUMNS = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("base_failed", "boolean"), ("kept", "boolean"), ("chars_per_piece", "double"), ("chars_per_token", "double"),
    ("byte_share", "double"), ("entropy", "double"), ("script", "string"), ("n_pieces", "long"),
]
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}


def _measurer(piece_path: str | None, byte_path: str | None, bands: Bands):
    piece_path, byte_path = piece_path or default_path("piece_bpe_32k.model"), byte_path or default_path("byte_bpe_multi_50k.tiktoken")
    held: list[WordPieces] = []

    def rows(texts: list[bytes], langs: list[str | None], block: int = 128, most: int = 500_000) -> list[tuple]:
        if not held:
            held.append(WordPieces(piece_path, byte_path))
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and end - at < block and (size := size + len(texts[end])) <= most or end == at:
                end += 1
            out += measure(texts[at:end], langs[at:end], held[0], bands)
            at = end
        return out

    return rows


MEASURES = ("chars_per_piece", "chars_per_token", "byte_share", "entropy")
BIN = 1 / 1024
FEW = 2_000_000  # ids of labels that are broadcast


def fit_bands(docs: DataFrame, labels: DataFrame, *, label: str = "quality", tail: float = 0.002, margin: float = 0.6, least: int = 30, few: int = FEW, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", piece_path: str | None = None, byte_path: str | None = None) -> Bands:
    """Bands from all good labelled texts that pass the base rules, never held-out ones; of rows with one id from that whose text has the least hash.

    At most ``few`` labels are broadcast and only labelled texts measured. Else all that are not held out are, and their measures, not the texts, meet the labels.
    """
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    good = materialize(labels.where((F.col(label) == 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select(F.col("doc_id").alias("k")).distinct(), "labels")
    texts = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    broadcast = good.count() <= few
    if broadcast:
        texts = texts.join(F.broadcast(good), texts[id_col] == F.col("k"), "left_semi")
    texts = texts.select(F.struct(F.col(id_col).alias("k"), F.xxhash64(F.col(text_col).cast("binary")).alias("h")).alias("i"), F.col(text_col).alias("t"), lang.alias("lang"))
    rows = quality_measures(texts, id_col="i", text_col="t", lang_col="lang", piece_path=piece_path, byte_path=byte_path, carry_lang=True)
    rows = rows.groupBy("doc_id.k").agg(F.min(F.struct("doc_id.h", "lang", "script", "n_pieces", "base_failed", *MEASURES)).alias("r"))
    if not broadcast:
        rows = rows.join(good, "k", "left_semi")
    level = F.length(F.bin(F.greatest(F.col("n_pieces"), F.lit(1)))) - 1
    measured = materialize(rows.select("r.*").where("not base_failed").select(F.lower("lang").alias("lang"), "script", level.alias("level"), *MEASURES), "measures")
    keys = F.filter(F.array_distinct(F.array("lang", "script")), lambda k: k != "")
    values = measured.select(F.explode(keys).alias("key"), "level", *MEASURES).select("key", "level", F.posexplode(F.array(*MEASURES)).alias("m", "x"))
    fitted = {}
    for key, found in quantiles(values, (tail, 0.5, 1 - tail), least).items():
        low, mid, high = (np.array(x) for x in zip(*(found[m] for m in range(len(MEASURES))), strict=True))
        fitted[key] = tuple((low - margin * (mid - low) - 1e-3).tolist()), tuple((high + margin * (high - mid) + 1e-3).tolist())
    discard(measured)
    discard(good)
    return Bands(fitted)


def quantiles(values: DataFrame, shares: tuple[float, ...], least: int = 1) -> dict[tuple[str, int], dict[int, list[float]]]:
    """By key and level, for each measure ``m``, the quantiles of ``values(key, level, m, x)``, between two ranks linear; none for fewer than ``least`` values."""
    group = ["key", "level", "m"]

    def wanted(total: Column, first: Column, n: Column) -> Column:
        ranks = [F.floor((total - 1) * F.lit(q)) + up for q in shares for up in (0, 1)]
        return F.exists(F.array(*ranks), lambda r: (r >= first) & (r < first + n))

    def ranked(counts: DataFrame, by: list[str], order: str, first: Column) -> DataFrame:
        before = F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        return counts.withColumn("first", first + before)

    values = values.withColumn("bin", F.floor(F.col("x") / BIN))
    bins = ranked(values.groupBy(*group, "bin").agg(F.count("*").alias("n")), group, "bin", F.lit(0)).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    bins = bins.where((F.col("total") >= least) & wanted(F.col("total"), F.col("first"), F.col("n"))).select(*group, "bin", F.col("first").alias("start"), "total")
    inside = values.join(F.broadcast(bins), [*group, "bin"]).groupBy(*group, "bin", "start", "total", "x").agg(F.count("*").alias("n"))
    held = ranked(inside, [*group, "bin"], "x", F.col("start")).where(wanted(F.col("total"), F.col("first"), F.col("n"))).collect()
    at: dict[tuple[str, int], dict[int, list]] = {}
    for r in held:
        at.setdefault((r["key"], r["level"]), {}).setdefault(r["m"], []).append((r["first"], r["first"] + r["n"], r["x"], r["total"]))
    out: dict[tuple[str, int], dict[int, list[float]]] = {}
    for key, found in at.items():
        for m, runs in found.items():
            total = runs[0][3]
            value = lambda rank: next(x for a, b, x, _ in runs if a <= min(rank, total - 1) < b)  # noqa: B023, E731
            places = [((total - 1) * q, int((total - 1) * q)) for q in shares]
            out.setdefault(key, {})[m] = [value(k) + (value(k + 1) - value(k)) * (p - k) for p, k in places]
    return out


def quality_measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", bands: Bands | None = None, piece_path: str | None = None, byte_path: str | None = None, carry_lang: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id and ``COLUMNS``, and with ``carry_lang`` the language. One pass, no shuffle."""
    rows = _measurer(piece_path, byte_path, bands or Bands())
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(text_col).cast("binary").alias("t"), lang.alias("g"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = list(zip(*rows(bytes_of(batch.column(1)), batch.column(2).to_pylist()), strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, _ARROW[k]) for v, (_, k) in zip(got, COLUMNS, strict=True)), *[batch.column(2)] * carry_lang], names=["doc_id", *(n for n, _ in COLUMNS)] + ["lang"] * carry_lang)

    return map_batches(source, run, f"doc_id {id_type(docs, id_col)}, " + ", ".join(f"{n} {k}" for n, k in COLUMNS) + ", lang string" * carry_lang)


def keep_good(docs: DataFrame, *, text_col: str = "text", lang_col: str | None = "lang", bands: Bands | None = None, piece_path: str | None = None, byte_path: str | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    rows = _measurer(piece_path, byte_path, bands or Bands())
    at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col in docs.columns else None

    def decide(batch: pa.RecordBatch) -> pa.Array:
        langs = batch.column(lang_at).to_pylist() if lang_at is not None else [None] * batch.num_rows
        return pa.array([r[6] for r in rows(bytes_of(batch.column(at)), langs)], pa.bool_())

    return keep_rows(docs, decide)
