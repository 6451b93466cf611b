"""Tokenising words with public vocabularies, each distinct word once."""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def piece_processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def byte_piece_ids(path: str) -> np.ndarray:
    """True at the ids of byte-fallback pieces."""
    sp = piece_processor(path)
    return np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    """A byte-level vocabulary, given as ranks of its tokens."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class WordPieces:
    """The pieces of each distinct word, as arrays indexed by a number given to the word, and with ``byte_path`` the number of its
    tokens in that vocabulary. Emptied when full, so memory is bounded."""

    def __init__(self, piece_path: str, byte_path: str | None = None, limit: int = 100_000):
        self.piece_path, self.byte_path, self.limit = piece_path, byte_path, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.ends = np.empty(1 << 18, dtype=np.int32), np.zeros(self.limit + 1, dtype=np.int32)
        self.tokens = np.zeros(self.limit, dtype=np.int32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word; unseen ones are tokenised first. Numbers hold until the next call."""
        new = list(set(words).difference(self.index))
        if len(self.index) + len(new) > self.limit:
            self.clear()
            new = list(set(words))
            if len(new) > self.limit:
                self.ends, self.tokens = np.zeros(len(new) + 1, dtype=np.int32), np.zeros(len(new), dtype=np.int32)
        if new:
            shown = [w.decode("utf-8", "replace") for w in new]
            ids = piece_processor(self.piece_path).encode(shown, num_threads=1)
            n = len(self.index)
            if self.byte_path:
                encode = byte_encoder(self.byte_path).encode_ordinary
                self.tokens[n : n + len(new)] = [len(encode(" " + w)) for w in shown]
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            start = int(self.ends[n])
            self.ends[n + 1 : n + len(new) + 1] = start + np.cumsum(sizes)
            need = start + int(sizes.sum())
            if need > len(self.flat):
                self.flat = np.concatenate([self.flat[:start], np.empty(max(need, 2 * len(self.flat)) - start, dtype=np.int32)])
            self.flat[start:need] = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=need - start)
        return np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))

    def pieces(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many pieces each word has, and the pieces of all of them in order."""
        starts = self.ends[numbers].astype(np.int64)
        sizes = self.ends[numbers + 1] - starts
        shift = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        return sizes, self.flat[shift + np.arange(len(shift))]
