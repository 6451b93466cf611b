"""SentencePiece encoding and decoding that keeps the place of every piece in the original text.

Encoding has three steps. *Normalisation* replaces, at each place, the longest prefix that the model's compiled character map
knows, adds the dummy prefix, squeezes and escapes white space as the model asks, and records for every normalised byte the
original byte it came from. *Segmentation* into pieces is the sentencepiece library's. *Projection* turns the pieces' lengths into
spans of normalised bytes and these, through the recorded alignment, into spans of original bytes.

Where the model allows it, segmentation is done once per distinct word: if no piece holds a white space mark after another
character, no merge or lattice arc can cross from a word into the next mark, so a text's pieces are its words' pieces. Models or
texts for which this does not hold (texts with a literal mark, models with a character map) are segmented whole.

Defined cases: a null or empty text has no pieces, only the end id where one is asked for, and decodes to the empty text; white
space is text like any other; a text of any length is encoded whole; repeated rows are encoded each; an empty table gives an empty
result; other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, empty_if_null, map_batches
from .words import WordPieces, default_path, piece_processor

MARK = "▁".encode()


def read_charsmap(blob: bytes) -> dict[bytes, bytes]:
    """The replacements in a compiled character map: a double-array trie of byte strings, then their zero-ended replacements."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units, texts = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist(), blob[4 + size :]

    def jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    found: dict[bytes, bytes] = {}
    stack = [(jump(units[0]), b"")]
    while stack:
        at, key = stack.pop()
        for byte in range(1, 256):
            to = at ^ byte
            if to < len(units) and units[to] & 0x800000FF == byte:
                down, word = to ^ jump(units[to]), key + bytes([byte])
                if units[to] >> 8 & 1:
                    begin = units[down] & 0x7FFFFFFF
                    found[word] = texts[begin : texts.index(b"\0", begin)]
                stack.append((down, word))
    return found


class Normalizer:
    """What a model does to a text before it is segmented, with the alignment to the original bytes."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(proto)
        spec = model.normalizer_spec
        self.map = read_charsmap(spec.precompiled_charsmap)
        self.own = [p.piece.encode() for p in model.pieces if p.type == pb.ModelProto.SentencePiece.USER_DEFINED]
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.plain = not (self.map or self.own or self.squeeze or self.suffix) and self.escape
        self.whole_words = self.plain and self.dummy and not any(re.search("[^▁]▁", p.piece) for p in model.pieces)
        keys = sorted({**{k: 1 for k in self.map}, **{k: 1 for k in self.own}}, key=len, reverse=True)
        self.longest = max(map(len, keys), default=0)
        self.own_set, self.first = set(self.own), {k[:1] for k in keys}

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and for their end the place in ``text``."""
        if not text:
            return b"", np.zeros(1, dtype=np.int64)
        if self.plain:
            raw = np.frombuffer(text, dtype=np.uint8)
            place = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(MARK), 1))
            head = MARK if self.dummy else b""
            return head + text.replace(b" ", MARK), np.r_[np.zeros(len(head), dtype=np.int64), place, len(raw)]
        mark = MARK if self.escape else b" "
        parts: list[tuple[bytes, int]] = []
        at = 0
        while at < len(text):
            piece, used = self._prefix(text, at)
            parts.append((piece, at))
            at += used
        if self.squeeze:
            while parts and not parts[0][0].strip(b" "):
                parts.pop(0)
            if not parts:
                return b"", np.zeros(1, dtype=np.int64)
        begin = parts[0][1]
        out, place, after_space = bytearray(), [], self.squeeze
        if self.dummy and not self.suffix:
            out += mark
            place += [begin] * len(mark)
        for piece, at in parts:
            shown = piece.lstrip(b" ") if after_space else piece
            for byte in shown:
                add = mark if byte == 32 else bytes([byte])
                out += add
                place += [at] * len(add)
            if shown:
                after_space = self.squeeze and shown.endswith(b" ")
        end = len(text)
        if self.squeeze:
            while out.endswith(mark):
                end = place[len(out) - len(mark)]
                del out[-len(mark) :], place[-len(mark) :]
        if self.dummy and self.suffix:
            out += mark
            place += [end] * len(mark)
        return bytes(out), np.array([*place, end], dtype=np.int64)

    def _prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        if text[at : at + 1] in self.first:
            for n in range(min(self.longest, len(text) - at), 0, -1):
                key = text[at : at + n]
                if key in self.own_set:
                    return key, n
            for n in range(min(self.longest, len(text) - at), 0, -1):
                key = text[at : at + n]
                if key in self.map:
                    return self.map[key], n
        lead = text[at]
        n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return text[at : at + n], n


@lru_cache(maxsize=4)
def normalizer(path: str) -> Normalizer:
    with open(path, "rb") as f:
        return Normalizer(f.read())


@lru_cache(maxsize=4)
def piece_bytes(path: str) -> np.ndarray:
    """How many normalised bytes each id stands for; -1 for the unknown piece, whose length the text decides, 0 for control ids."""
    sp = piece_processor(path)
    return np.array([1 if sp.is_byte(i) else 0 if sp.is_control(i) else -1 if sp.is_unknown(i) else len(sp.id_to_piece(i).encode()) for i in range(sp.get_piece_size())])


class Encoder:
    """Encodes blocks of texts; one per task."""

    def __init__(self, path: str, add_end: bool = True):
        self.path, self.add_end, self.sp, self.norm, self.table = path, add_end, piece_processor(path), normalizer(path), WordPieces(path)
        self.end = np.array([self.sp.eos_id()] * add_end, dtype=np.int32)

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them for the whole text."""
        words: list[bytes] = []
        sizes = []
        for text in texts:
            before = len(words)
            if text and self.norm.whole_words and MARK not in text and not re.search(rb"[^ ] \Z", text[-2:]):  # a lone last mark is no word
                parts = text.split(b" ")
                words += parts if b"" not in parts else _with_spaces(parts)
            sizes.append(len(words) - before)
        counts, flat = self.table.pieces(self.table.numbers(words)) if words else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        ends = np.r_[0, np.cumsum(counts)][np.r_[0, np.cumsum(sizes, dtype=np.int64)]]
        out = []
        for i, text in enumerate(texts):
            if sizes[i] or not text:
                got = flat[ends[i] : ends[i + 1]]
            else:
                got = np.array(self.sp.encode(text.decode("utf-8", "replace"), num_threads=1), dtype=np.int64)
            out.append(np.concatenate([got, self.end]).astype(np.int32))
        return out

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each id the original bytes [start, end) it stands for; ids without text have an empty span."""
        normal, place = self.norm(text)
        sizes = piece_bytes(self.path)[ids]
        if (sizes < 0).any():
            pieces = self.sp.encode(text.decode("utf-8", "replace"), out_type=str)
            sizes = np.where(sizes < 0, [len(p.encode()) for p in pieces] + [0] * (len(ids) - len(pieces)), sizes)
        edges = np.r_[0, np.cumsum(sizes)]
        if edges[-1] != len(normal):
            raise ValueError("the pieces do not add up to the normalised text")
        return place[edges[:-1]], place[edges[1:]]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return [self.sp.decode(x.tolist()) for x in ids]


def _with_spaces(parts: list[bytes]) -> list[bytes]:
    """Parts of a text split at single spaces, with runs of spaces put before the word that follows them."""
    out, spaces = [], 0
    for part in parts[:-1]:
        if part:
            out.append(b" " * spaces + part)
            spaces = 0
        else:
            spaces += 1
    out.append(b" " * spaces + parts[-1])
    return out


def _blocks(texts: list[bytes], most: int = 1_000_000):
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def encode(docs: DataFrame, *, model_path: str | None = None, add_end: bool = True, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, starts, ends``: the ids of every text and the original bytes each of them stands for. With ``decoded`` also
    ``decoded_sha256``, the digest of the text that the ids decode to. What a few megabytes of text become is handed on at once."""
    path = model_path or default_path("piece_bpe_32k.model")
    held: list[Encoder] = []
    names = ["doc_id", "ids", "starts", "ends"] + ["decoded_sha256"] * decoded

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Encoder(path, add_end))
        texts = bytes_of(batch.column(1))
        for a, b in _blocks(texts):
            ids = held[0].ids(texts[a:b])
            spans = [held[0].spans(t, i) for t, i in zip(texts[a:b], ids, strict=True)]
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32))) for x in (ids, [s for s, _ in spans], [e for _, e in spans])]
            if decoded:
                lists.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in held[0].decode(ids)], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], names=names)

    source = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(text_col).cast("binary").alias("t"))
    return map_batches(source, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>" + ", decoded_sha256 string" * decoded)


def decode(encoded: DataFrame, *, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the library's text for every list of ids; null counts as no ids."""
    path = model_path or default_path("piece_bpe_32k.model")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sp = piece_processor(path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([sp.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), run, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, text string")


def digests(docs: DataFrame, *, model_path: str | None = None, add_end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text as ``encode`` and ``decode`` do and returns digests in place of the ids and the text:
    ``doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, n_empty_spans``, the last two the original bytes that the pieces'
    spans cover and the pieces without any."""
    path = model_path or default_path("piece_bpe_32k.model")
    held: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.extend([Encoder(path, add_end), [str(i) for i in range(piece_processor(path).get_piece_size())]])
        encoder, names = held
        texts, out = bytes_of(batch.column(1)), []
        for a, b in _blocks(texts):
            ids = encoder.ids(texts[a:b])
            for text, own, decoded in zip(texts[a:b], ids, encoder.decode(ids), strict=True):
                starts, ends = encoder.spans(text, own)
                joined = " ".join([names[i] for i in own.tolist()])
                out.append((len(own), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), int((ends - starts).sum()), int((ends == starts).sum())))
        got = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(got, kinds, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "n_empty_spans"])

    source = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(text_col).cast("binary").alias("t"))
    return map_batches(source, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, n_empty_spans long")
