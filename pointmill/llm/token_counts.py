"""Counts of unigram tokens by a Viterbi search that keeps only scores and counts.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a text. For every place the best score of a segmentation that ends
there, its number of pieces and whether the last one is unknown are kept, never the pieces. The rules are the unigram tokeniser's:

* of equal scores the piece that begins first wins;
* a character that no piece covers alone is unknown, ten below the worst ordinary piece. Neighbouring unknown characters make one
  piece; where the vocabulary has byte fallback, each counts as its UTF-8 bytes;
* a user-defined piece is worth its length in bytes times the best ordinary score, less 0.1.

Texts are normalised first, as the model asks. No piece holds a white space mark after another character (where one does, or where
the model has a character map or user-defined pieces, texts are searched whole), so every segmentation ends a piece before each word's mark: a text's best score and count are sums over its words, each
distinct word searched once.

Scores are summed in double precision. A tokeniser that sums in single precision can differ where a long text's sum no longer
resolves the difference between two segmentations.

Pieces and scores come from a sentencepiece model file; a BPE model's scores, minus the rank of each merge, serve as log
probabilities.

Defined cases: a null or empty text, or one that normalises to nothing, has no tokens and score 0; white space is text like any other;
repeated rows are counted each; an empty table gives an empty result; other columns are not read. Texts are counted whole.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, empty_if_null, id_type, map_batches
from .spm import normalizer
from .words import default_path, piece_processor

UNKNOWN_PENALTY = 10.0


class Lattice:
    """The automaton of a vocabulary and what a search needs to know about it."""

    def __init__(self, path: str):
        import ahocorasick

        sp = piece_processor(path)
        self.norm = normalizer(path)
        self.automaton, own = ahocorasick.Automaton(), {p.decode() for p in self.norm.own}
        pieces = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ordinary = [sp.get_score(i) for i in pieces if sp.id_to_piece(i) not in own]
        low, high = min(ordinary, default=0.0), max(ordinary, default=0.0)
        self.single: set[str] = set()
        for i in pieces:
            piece = sp.id_to_piece(i)
            self.automaton.add_word(piece, (len(piece), len(piece.encode()) * high - 0.1 if piece in own else sp.get_score(i)))
            if len(piece) == 1:
                self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = low - UNKNOWN_PENALTY
        self.fallback = any(sp.is_byte(i) for i in range(sp.get_piece_size()))

    def search(self, text: str) -> tuple[int, float]:
        """Number of pieces and score of the best segmentation of a normalised text."""
        low = float("-inf")
        best, count = [low] * (len(text) + 1), [0] * (len(text) + 1)
        odd = bytearray(len(text) + 1)
        best[0], done = 0.0, 0
        single = self.single
        covered = all(c in single for c in text)
        for end, (size, score) in self.automaton.iter(text):
            end += 1
            if not covered:
                # Unknown characters bridge the places before this match; an unknown piece begins after all longer ones.
                for at in range(done + 1, end):
                    self._bridge(text, at, best, count, odd)
                done = max(done, end - 1)
            start = end - size
            value = best[start] + score
            if value > best[end]:
                best[end], count[end], odd[end] = value, count[start] + 1, 0
        if not covered:
            for at in range(done + 1, len(text) + 1):
                self._bridge(text, at, best, count, odd)
        return count[-1], best[-1]

    def _bridge(self, text: str, at: int, best: list[float], count: list[int], odd: bytearray) -> None:
        c = text[at - 1]
        if c not in self.single and best[at - 1] + self.unknown > best[at]:
            best[at], odd[at] = best[at - 1] + self.unknown, 1
            count[at] = count[at - 1] + (len(c.encode()) if self.fallback else not odd[at - 1])


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


class Counter:
    """Counts tokens of texts; the results of distinct words are kept in a table of bounded size."""

    def __init__(self, path: str, limit: int = 300_000):
        self.lattice, self.limit, self.table = lattice(path), limit, {}

    def __call__(self, text: bytes) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if not self.lattice.norm.whole_words or "▁".encode() in text:
            normal = self.lattice.norm(text)[0].decode("utf-8", "replace")
            return self.lattice.search(normal) if normal else (0, 0.0)
        table, search = self.table, self.lattice.search
        words = text.split(b" ")
        if b"" in words:
            words = _joined(words)
        if len(table) > self.limit:
            table.clear()
        for w in set(words).difference(table):
            table[w] = search("▁" + w.decode("utf-8", "replace").replace(" ", "▁"))
        found = [table[w] for w in words]
        return sum([n for n, _ in found]), sum([s for _, s in found])


def _joined(words: list[bytes]) -> list[bytes]:
    """Words of a text split at single spaces, runs of spaces put before the word that follows them."""
    out, spaces = [], 0
    for w in words[:-1]:
        if w:
            out.append(b" " * spaces + w)
            spaces = 0
        else:
            spaces += 1
    out.append(b" " * spaces + words[-1])
    return out


def token_counts(docs: DataFrame, *, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, score`` for every row. One pass, no shuffle."""
    path = model_path or default_path("piece_bpe_32k.model")
    held: list[Counter] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Counter(path))
        got = [held[0](t) for t in bytes_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "n_tokens", "score"])

    source = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(text_col).cast("binary").alias("t"))
    return map_batches(source, run, f"doc_id {id_type(docs, id_col)}, n_tokens long, score double")
