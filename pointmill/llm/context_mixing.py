"""Language-model scores by online logistic context mixing.

A text is read from its start: its words, lower-cased, and one end; a word is spelt by its bytes and a closing space, the end is the empty word. Bytes are
decided bit by bit along a Huffman tree of the training bytes, so the probabilities of all texts add up to no more than one. For every bit six predictors
give the odds that training counts have under a context: the place in the word; the last one, two and four bytes of the text, across words; all
of the word so far; and, in a word's first three bytes, this with the word before, later the last three bytes. Counts lie in tables of fixed size, addressed by hashes of context and place in the tree. Their
logits are mixed by weights that a gate selects, the gate being how often the two most specific contexts were seen, and an adaptive map refines
the mixture by how it came out for like probabilities.

What is learned, and where:

* One pass cuts the documents into slices (consecutive documents with some 300,000 distinct words or 1,500,000 pairs) and writes each slice's distinct
  words, its distinct pairs of a word and the word before, and its documents' counts of pairs. All contexts of a word's bits are functions of the
  pair, and from the fourth byte on of the word: what pairs of a slice share (their first bytes after the same word, the rest of a word) is worked on once.
* Counts of words are hash aggregates over all training documents; tables of bit counts are summed over the tasks, in pieces and in a tree.
* Weights are learned online: each task goes through the pairs of its slices with Newton steps, each bit predicted by counts without its own
  occurrence; the tasks' weights are averaged, each by its curvature.

The driver and the broadcasts hold the tables, weights and maps only, whose size is fixed by ``table_bits``.

Defined cases: a null text counts as empty, and an empty one is its end alone; a null id is never held out; repeated rows count each; an
empty table gives an empty result; without training texts every bit has probability one half; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, discard, empty_if_null, id_type, materialize, release, slices

ORDERS, CONFIDENCE, BUCKETS = 6, 8, 33
PLACES = 16
#: The bytes of a word whose contexts reach into the word before.
REACH = 3
GATES = CONFIDENCE * CONFIDENCE
PIECE = 1 << 16
PART = 4096
#: Mixers of the hashes: odd 64-bit numbers.
ROLL, SPREAD, FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def in_training(column: str = "doc_id"):
    """False for rows whose crc32(id as text) mod 5 is 1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 != 1, F.lit(True))


def press(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def unpress(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class Tree:
    """A Huffman tree over all bytes: how many decisions each byte takes, at which nodes and with which outcomes."""

    def __init__(self, histogram: list[int]):
        heap = [(n + 1, b, b) for b, n in enumerate(histogram)]
        heapq.heapify(heap)
        children, new = {}, 256
        while len(heap) > 1:
            (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            children[new] = (a, b)
            heapq.heappush(heap, (n + m, new, new))
            new += 1
        paths: dict[int, list[tuple[int, int]]] = {}
        todo = [(new - 1, [])]
        while todo:
            at, path = todo.pop()
            if at < 256:
                paths[at] = path
            else:
                todo += [(child, [*path, (at - 256, bit)]) for bit, child in enumerate(children[at])]
        self.length = np.array([len(paths[b]) for b in range(256)])
        self.nodes, self.bits = np.zeros((256, self.length.max()), np.int64), np.zeros((256, self.length.max()), np.int64)
        for b, path in paths.items():
            self.nodes[b, : len(path)], self.bits[b, : len(path)] = [n for n, _ in path], [y for _, y in path]


def context_of(word: bytes) -> int:
    """What the words after ``word`` know of it: 39 bits of its hash and its last three bytes. The start of a text is the empty word."""
    return (xxhash.xxh64_intdigest(word) >> 25 << 24) | int.from_bytes(word[-3:], "big")


class Bits:
    """The bits of some units: the bytes from ``start`` to before ``stop`` of words that lie side by side in ``flat``, each with the space that closes it (``size``
    bytes), after a word before. A bit's slots are functions of the word alone (``slots``, by the bits of the words) but in tables 2 and 3 at bytes whose contexts reach
    into the word before (``reach``: table, which of the units' bits, slots); those of the last table are ``joint``."""

    def __init__(self, tree: Tree, table_bits: tuple[int, ...], flat: np.ndarray, size: np.ndarray, seconds: np.ndarray, before: np.ndarray, start: np.ndarray, stop: np.ndarray):
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        power = np.cumprod(np.full(int(size.max()), ROLL, np.uint64))
        term = (flat.astype(np.uint64) + np.uint64(1)) * power[at]
        run = np.cumsum(term) - term
        prefix = (run - run[np.arange(len(flat)) - at] + at.astype(np.uint64)) * SPREAD
        # The bytes before the word: a space, then, going back, the last ones of the word before, which are added pair by pair.
        last_bytes, context = np.zeros(len(flat), np.uint64), [np.minimum(at, PLACES - 1)]
        for back in (1, 2, 3, 4):
            shifted = np.concatenate([np.full(min(back, len(flat)), 32, np.uint8), flat[:-back]])[: len(flat)].astype(np.uint64)
            last_bytes = (last_bytes << np.uint64(8)) | np.where(at >= back, shifted, np.where(at == back - 1, np.uint64(32), np.uint64(0)))
            if back != 3:
                context.append(last_bytes + np.uint64(1))
        context += [prefix, np.where(at < REACH, prefix, ((last_bytes >> np.uint64(8)) + np.uint64(1)) * ROLL)]
        count = np.where((at >= start.min()) & (at < stop.max()), tree.length[flat], 0)
        byte = np.repeat(np.arange(len(flat)), count)
        step = np.arange(len(byte)) - np.repeat(np.cumsum(count) - count, count)
        node = tree.nodes[flat[byte], step]
        slot = lambda k, mixed: (mixed * FOLD >> np.uint64(64 - table_bits[k])).astype(np.int64)
        mixed = [None, *((c * SPREAD)[byte] + node.astype(np.uint64) for c in context[1:])]
        self.slots = [(context[0][byte] << 8) | node, *(slot(k, mixed[k]) for k in range(1, ORDERS - 1))]
        self.y = tree.bits[flat[byte], step]
        # The units' bits.
        bit = np.concatenate([[0], np.cumsum(count)])  # the first one of each byte
        word = np.cumsum(size) - size
        first = bit[word[seconds] + start]
        each = bit[word[seconds] + stop] - first
        self.ends = np.cumsum(each)
        self.of = np.repeat(np.arange(len(seconds)), each)
        whole = start.min() >= REACH and len(self.of) == len(byte) and len(seconds) == len(size)
        #: The bit of the words that each bit is; where units are rests of words in order, those are the same.
        self.at = slice(None) if whole else np.arange(len(self.of)) - np.repeat(self.ends - each - first, each)
        own = before.astype(np.uint64)
        place = np.minimum(at, REACH)[byte]
        head = np.zeros(0, np.int64) if whole else np.flatnonzero(place[self.at] < REACH)
        bits, unit = head if whole else self.at[head], self.of[head]
        where = place[bits]
        joint = mixed[5][self.at]
        if len(head):
            joint[head] += (((own >> np.uint64(24)) + np.uint64(1)) * FOLD * SPREAD)[unit]
        self.joint = slot(5, joint)
        back = ((own & np.uint64(255)) << np.uint64(16)) | (own & np.uint64(0xFF00)) | ((own >> np.uint64(16)) & np.uint64(255))
        initial = where == 0
        self.reach = [
            (2, head[initial], slot(2, mixed[2][bits[initial]] + (back[unit[initial]] >> np.uint64(16)) * SPREAD)),
            (3, head, slot(3, mixed[3][bits] + (back[unit] >> (where << 3).astype(np.uint64)) * SPREAD)),
        ]
        self.reaching = {2: place == 0, 3: place < REACH}


class Units:
    """What pairs of a word and the word before are made of, each distinct part once: a first, second or third byte after what stands before it, and the
    rest of a word, which does not depend on the word before. ``text``: words, closed by a space each; ``seconds``: the places of the pairs' words;
    ``knows`` at ``firsts``: the ``context_of`` the words before; ``n``: the pairs' counts, which ``self.n`` sums by unit."""

    def __init__(self, text: np.ndarray, seconds: np.ndarray, firsts: np.ndarray, knows: np.ndarray, n: np.ndarray):
        self.text, self.knows, ends = text, knows, np.flatnonzero(text == 32) + 1
        self.begins = np.concatenate([[0], ends[:-1]])
        self.size = ends - self.begins
        self.seconds_of_pairs = seconds
        # A word stands for all that begin as it does.
        key, first_like = np.zeros(len(ends), np.int64), []
        for h in range(REACH):
            key |= np.where(self.size > h, text[np.minimum(self.begins + h, len(text) - 1)].astype(np.int64) << 8 * h, 0)
        starts, one, which = np.unique(key, return_index=True, return_inverse=True)
        for h in range(REACH):
            _, first, same = np.unique(starts & ((1 << 8 * (h + 1)) - 1), return_index=True, return_inverse=True)
            first_like.append(one[first][same][which])
        tail = np.bincount(seconds, minlength=len(ends)) > 0
        tail &= self.size > REACH
        self.kept, self.back = [np.flatnonzero(tail).astype(np.int32)], []
        parts = [(self.kept[0], np.zeros(len(self.kept[0]), np.int32), np.bincount(seconds, weights=n, minlength=len(ends))[tail], REACH)]
        code = (seconds.astype(np.int64) << 32) | firsts
        for h in reversed(range(REACH)):
            code = (first_like[h][code >> 32] << 32) | (code & 0xFFFFFFFF)
            order = np.argsort(code)
            code = code[order]
            new = np.diff(code, prepend=-1) != 0
            back = np.empty(len(code), np.int32)
            back[order] = np.cumsum(new, dtype=np.int32) - 1
            del order
            code = code[new]
            n = np.bincount(back, weights=n, minlength=len(code))
            kept = np.flatnonzero(self.size[code >> 32] > h).astype(np.int32)
            parts.append(((code[kept] >> 32).astype(np.int32), (code[kept] & 0xFFFFFFFF).astype(np.int32), n[kept], h))
            self.kept.append(kept)
            self.back.append((back, len(code)))
        self.seconds, self.firsts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        self.n = np.concatenate([p[2] for p in parts]).astype(np.int64)
        self.start = np.repeat(np.array([p[3] for p in parts], np.int8), [len(p[0]) for p in parts])

    def pieces(self, tree: Tree, table_bits: tuple[int, ...], limit: int = 1 << 15):
        """The first unit, the last but one and the ``Bits`` of pieces of about ``limit`` bytes, in an order that mixes the kinds of units."""
        size = np.where(self.start < REACH, 1, self.size[self.seconds] - REACH)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // limit, prepend=-1)).tolist() + [len(self.seconds)]
        del size
        parts = [(a, z) for a, z in zip(cuts, cuts[1:], strict=False) if a < z]
        for i in np.random.default_rng(0).permutation(len(parts)):
            a, z = parts[i]
            seconds, start = self.seconds[a:z], self.start[a:z].astype(np.int64)
            stop = np.where(start < REACH, start + 1, self.size[seconds])
            yield a, z, bits_of(tree, table_bits, self.text, self.begins, self.size, seconds, self.knows[self.firsts[a:z]], start, stop)

    def of_pairs(self, found: np.ndarray) -> np.ndarray:
        """The pairs' sums of what was ``found`` for the units."""
        found = np.split(found, np.cumsum([len(k) for k in self.kept])[:-1])
        total = 0
        for kept, own, (back, size) in zip(self.kept[:0:-1], found[:0:-1], self.back[::-1], strict=True):
            here = np.zeros(size)
            here[kept] = own
            total = (here + total)[back]
        words = np.zeros(len(self.size))
        words[self.kept[0]] = found[0]
        return total + words[self.seconds_of_pairs]


def bits_of(tree: Tree, table_bits: tuple[int, ...], text: np.ndarray, begins: np.ndarray, sizes: np.ndarray, seconds: np.ndarray, before: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Bits:
    """The bits of units, whose words are at the places ``seconds`` of ``text``."""
    used, local = np.unique(seconds, return_inverse=True)
    size = sizes[used]
    flat = text[np.arange(size.sum()) + np.repeat(begins[used] - (np.cumsum(size) - size), size)]
    return Bits(tree, table_bits, flat, size, local, before, start, stop)


def decisions(tree: Tree, table_bits: tuple[int, ...], words: list[bytes], before: np.ndarray, limit: int = 1 << 16):
    """``of, y, slots`` in pieces of about ``limit`` bytes: the word that each bit belongs to, the bit, and its slot in each table. ``before``: the
    ``context_of`` the word before each."""
    text, sizes = np.frombuffer(b" ".join(words) + b" ", np.uint8), np.fromiter(map(len, words), np.int64, len(words)) + 1
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit, prepend=-1)).tolist() + [len(words)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        if a < z:
            bits = bits_of(tree, table_bits, text, np.cumsum(sizes) - sizes, sizes, np.arange(a, z), before[a:z], np.zeros(z - a, np.int64), sizes[a:z])
            slots = np.stack([*(s[bits.at] for s in bits.slots), bits.joint])
            for k, which, own in bits.reach:
                slots[k, which] = own
            yield a + bits.of, bits.y[bits.at], slots


def confidence(n: np.ndarray) -> np.ndarray:
    """Eight levels of how often a context was seen."""
    return np.minimum(CONFIDENCE - 1, (np.log2(np.maximum(n, 0) + 1) / 2).astype(np.int64))


def logit(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.4) / (n0 + 0.4))


class Mixer:
    """Weights by gate, and the map that refines the mixture."""

    def __init__(self, weights: np.ndarray | None = None, seen: np.ndarray | None = None):
        self.weights = np.concatenate([np.full((GATES, ORDERS), 0.3), np.zeros((GATES, 1))], axis=1) if weights is None else weights
        self.seen = np.zeros((GATES, BUCKETS, 2)) if seen is None else seen

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The mixture's logit for rows of logits."""
        return np.clip(np.einsum("ij,ij->i", x, self.weights[gate]), -16, 16)

    def chance(self, z: np.ndarray, gate: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The probability of the bits ``y``: half the mixture's, half what the two nearest cells of the map have seen."""
        p = 1 / (1 + np.exp(np.where(y == 1, -z, z)))
        place = (z + 16) * ((BUCKETS - 1) / 32)
        low = np.minimum(place.astype(np.int64), BUCKETS - 2)
        centre = 1 / (1 + np.exp(-(np.arange(BUCKETS) * 32 / (BUCKETS - 1) - 16)))
        rate = (self.seen + 16 * np.stack([1 - centre, centre], axis=1)) / (self.seen.sum(axis=2, keepdims=True) + 16)
        rate = rate.astype(z.dtype).reshape(-1)
        cell = (gate * BUCKETS + low) * 2 + y
        lower = rate[cell]
        return 0.5 * p + 0.5 * (lower + (place - low.astype(z.dtype)) * (rate[cell + 2] - lower))

    def refine(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The probability of a one."""
        return self.chance(z, gate, np.ones(len(z), np.int64))

    def learn(self, x: np.ndarray, y: np.ndarray, gate: np.ndarray, weight: np.ndarray, curve: np.ndarray) -> None:
        """A Newton step of each gate on these bits, with the curvature of all bits so far; then the map takes note of them."""
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        x, y, gate, weight = np.take(x.T, order, axis=1), y[order], gate[order], weight[order]
        here = np.flatnonzero(n := np.bincount(gate, minlength=GATES))
        rows = [slice(end - n[g], end) for g, end in zip(here, np.cumsum(n)[here], strict=True)]
        z = np.concatenate([self.weights[g].astype(x.dtype) @ x[:, r] for g, r in zip(here, rows, strict=True)])
        np.clip(z, -16, 16, out=z)
        cell = (gate * BUCKETS + ((z + 16) * ((BUCKETS - 1) / 32) + 0.5).astype(np.int64)) * 2 + y
        self.seen += np.bincount(cell, weights=weight, minlength=self.seen.size).reshape(self.seen.shape)
        p = 1 / (1 + np.exp(-z))
        pull, bent = weight * (y.astype(x.dtype) - p), x * (weight * np.maximum(p * (1 - p), 1e-4))
        curve[here] += np.stack([bent[:, r] @ x[:, r].T for r in rows])
        step = np.linalg.solve(curve[here] + np.eye(ORDERS + 1), np.stack([x[:, r] @ pull[r] for r in rows]).astype(float)[:, :, None])[:, :, 0]
        self.weights[here] += step * np.minimum(1.0, 0.5 / np.maximum(1e-12, np.abs(step).max(axis=1)))[:, None]


class Model:
    """Tables of counts, a mixer and a tree: what scores words."""

    def __init__(self, tree: Tree, table_bits: tuple[int, ...], counts: list[np.ndarray], mixer: Mixer, shares: np.ndarray | None = None):
        """``shares`` is not used: texts had classes once."""
        self.tree, self.table_bits, self.mixer = tree, table_bits, mixer
        self.logits = [logit(c[0::2], c[1::2]).astype(np.float32) for c in counts]
        self.sure = [confidence(counts[k][0::2] + counts[k][1::2]).astype(np.uint8) for k in (3, 5)]

    def __call__(self, words: list[bytes], before: np.ndarray) -> np.ndarray:
        """log10 of the probability of every word after the word before it."""
        every = np.arange(len(words))
        units = Units(np.frombuffer(b" ".join(words) + b" ", np.uint8), every, every, before, every)
        return units.of_pairs(self.of_units(units)) if words else np.zeros(0)

    def of_units(self, units: Units) -> np.ndarray:
        """The same for each of the units."""
        out, weights = np.zeros(len(units.seconds)), self.mixer.weights.astype(np.float32)
        for first, last, bits in units.pieces(self.tree, self.table_bits):
            own = np.ones((len(bits.y), ORDERS + 1), np.float32)
            for k, s in enumerate(bits.slots):
                own[:, k] = self.logits[k][s]
            x = own if isinstance(bits.at, slice) else own.take(bits.at, axis=0)
            x[:, 5] = self.logits[5][bits.joint]
            for k, which, s in bits.reach:
                x[which, k] = self.logits[k][s]
            sure = self.sure[0][bits.slots[3]][bits.at]
            sure[bits.reach[1][1]] = self.sure[0][bits.reach[1][2]]
            gate = (self.sure[1][bits.joint] * np.uint8(CONFIDENCE) + sure).astype(np.int64)
            z = np.clip(np.einsum("ij,ij->i", x, weights.take(gate, axis=0)), -16, 16)
            lp = np.log10(self.mixer.chance(z, gate, bits.y[bits.at]))
            out[first:last] = np.add.reduceat(lp, np.concatenate([[0], bits.ends[:-1]]), dtype=np.float64)
        return out


WHOLE = ("slice", "ids", "train", "bytes", "ends", "places", "counts", "firsts", "seconds", "learned", "text")


def cut(docs: DataFrame, id_col: str, text_col: str, words_per_slice: int, entries: int) -> DataFrame:
    """Slices of documents and their words in one table. Rows with a ``word`` (``slice, place, word, n``): a distinct word, the empty one among them, its place
    in the slice and its count in training texts. Rows with ``ids``: the slice's documents, its words' ``text``, its distinct pairs by the places of the
    word before and the word (``firsts, seconds``) with their counts in training texts (``learned``), and the documents' pairs in their ``counts``."""
    kind = docs.select(F.col(id_col).alias("i"), empty_if_null(text_col).cast("binary").alias("t"), in_training(id_col).alias("train"))

    def run(batches):
        task, turn = TaskContext.get().partitionId(), 0
        index, words = {b"": 0}, [b""]
        ids, held, size, codes, counts = ([] for _ in range(5))
        histogram, seen = np.zeros(256, np.int64), 0

        def flush():
            nonlocal turn, seen
            number, lengths = (task << 32) | turn, list(map(len, codes))
            every, code = np.concatenate(counts), np.concatenate(codes)
            counts.clear(), codes.clear()
            order = np.argsort(code)
            code = code[order]
            new = np.diff(code, prepend=-1) != 0
            places = np.empty(len(code), np.int32)
            places[order] = np.cumsum(new, dtype=np.int32) - 1
            pairs = code[new]
            del code, order, new
            learned = np.bincount(places, weights=np.where(np.repeat(held, lengths), every, 0), minlength=len(pairs)).astype(np.int64)
            seconds, firsts = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
            del pairs
            n = np.bincount(seconds, weights=learned, minlength=len(words)).astype(np.int64)
            for at in range(0, len(words), 20_000):
                part = slice(at, min(len(words), at + 20_000))
                m = part.stop - at
                none = [pa.nulls(m, f.type) for f in schema][4:]
                yield pa.RecordBatch.from_arrays([pa.array([number] * m, pa.int64()), pa.array(range(at, part.stop), pa.int32()), pa.array(words[part], pa.binary()), pa.array(n[part], pa.int64()), *none], schema=schema)
            one = lambda x: pa.array([x])
            listed = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays(ids))
            packed = [one(press(x)) for x in (places, every.astype(np.int64), firsts, seconds, learned)]
            text = one(press(np.frombuffer(b" ".join(words), np.uint8)))
            yield pa.RecordBatch.from_arrays(
                [one(number), *[pa.nulls(1, f.type) for f in schema][1:4], listed, one(held), one(size), one(np.cumsum([0, *lengths]).tolist()), *packed, text, one(histogram.tolist())], schema=schema
            )
            turn, seen = turn + 1, 0
            histogram[:] = 0
            for x in (words, ids, held, size, codes, counts, index):
                x.clear()
            index[b""] = 0
            words.append(b"")

        schema = None
        for batch in slices(batches):
            if schema is None:
                schema = [("slice", pa.int64()), ("place", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("ids", pa.list_(batch.column(0).type)), ("train", pa.list_(pa.bool_()))]
                schema += [("bytes", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), *((c, pa.binary()) for c in WHOLE[5:])]
                schema = pa.schema([*schema, ("histogram", pa.list_(pa.int64()))])
            for r, (text, trains) in enumerate(zip(bytes_of(batch.column(1)), batch.column(2).to_pylist(), strict=True)):
                text = text.lower()
                got = text.split()  # at the ASCII white space
                new = [w for w in dict.fromkeys(got) if w not in index]
                index.update(zip(new, range(len(words), len(words) + len(new)), strict=True))
                words += new
                line = np.zeros(len(got) + 2, np.int64)
                line[1:-1] = np.fromiter(map(index.__getitem__, got), np.int64, len(got))
                code, count = np.unique((line[1:] << 32) | line[:-1], return_counts=True)
                count = count.astype(np.int32)
                if trains:
                    # White space is read as the one space that closes each word.
                    own = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
                    own[9:14], own[32] = 0, len(got) + 1
                    histogram += own
                ids.append(batch.column(0).slice(r, 1))
                for x, v in ((held, bool(trains)), (size, len(text)), (codes, code), (counts, count)):
                    x.append(v)
                seen += len(code)
                if len(words) >= words_per_slice or seen >= entries:
                    yield from flush()
        if ids:
            yield from flush()
        index, words = {}, []
        release()

    item = id_type(docs, id_col)
    return kind.mapInArrow(
        run,
        f"slice long, place int, word binary, n long, ids array<{item}>, train array<boolean>, bytes array<long>, ends array<long>, places binary, counts binary, firsts binary, seconds binary, learned binary, text binary, histogram array<long>",
    )


def _units(row: dict, learned_only: bool) -> Units:
    """The units of a slice's pairs, with their counts in training texts."""
    text = unpress(row["text"], np.uint8).tobytes()
    words = text.split(b" ")
    knows = np.fromiter(map(context_of, words), np.int64, len(words))
    del words
    firsts, seconds, n = unpress(row["firsts"], np.int32), unpress(row["seconds"], np.int32), unpress(row["learned"], np.int64)
    if learned_only:
        keep = n > 0
        firsts, seconds, n = firsts[keep], seconds[keep], n[keep]
    return Units(np.frombuffer(text + b" ", np.uint8), seconds, firsts, knows, n)


def _rows(df: DataFrame, tree: Tree, table_bits: tuple[int, ...], fn, schema: str) -> DataFrame:
    """``mapInArrow`` with a generator of the units of the training pairs of ``df``, as ``Bits`` and counts, and the task's number, run to its end in each task."""

    def each(batches):
        for b in slices(batches, 1):
            units = _units(b.to_pylist()[0], True)
            for first, last, bits in units.pieces(tree, table_bits):
                yield bits, units.n[first:last]
            del units

    def run(batches):
        yield from fn(each(batches), TaskContext.get().partitionId())
        release()

    return df.where("ids is not null").select("firsts", "seconds", "learned", "text").mapInArrow(run, schema)


def _count(table: DataFrame, tree: Tree, table_bits: tuple[int, ...], most: int = 2**31 - 1) -> list[np.ndarray]:
    """How often training texts go on with a zero and with a one, slot by slot of each table. Tasks hand on pieces of their tables, which
    are summed 32 tasks at a time, until one of each is left. A task's tables hold ``most`` occurrences at a time."""

    def task(found, number):
        tables, room = [np.zeros(2 << bits, np.int32) for bits in table_bits], most

        def hand_on():
            for k, t in enumerate(tables):
                for at in range(0, len(t), PIECE):
                    if t[at : at + PIECE].any():
                        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([k], pa.int32()), pa.array([at], pa.int64()), pa.array([press(t[at : at + PIECE].astype(np.int64))], pa.binary())], names=["part", "k", "at", "data"])
                t[:] = 0

        for bits, counted in found:
            cap = max(1, most // max(1, len(bits.of)))
            while counted.any():  # once, but for counts that a table could not hold
                n = np.minimum(counted, cap)
                counted = counted - n
                n, y = n[bits.of], bits.y
                if n.sum() > room:
                    yield from hand_on()
                    room = most
                room -= n.sum()
                n = n.astype(np.int32)
                own = n if isinstance(bits.at, slice) else np.bincount(bits.at, weights=n, minlength=len(y)).astype(np.int32)
                for k, s in enumerate(bits.slots):
                    np.add.at(tables[k], s * 2 + y, np.where(bits.reaching[k], np.int32(0), own) if k in bits.reaching else own)
                y = y[bits.at]
                for k, which, s in bits.reach:
                    np.add.at(tables[k], s * 2 + y[which], n[which])
                np.add.at(tables[5], bits.joint * 2 + y, n)
        yield from hand_on()

    def fold(table: pa.Table) -> pa.Table:
        total = sum(unpress(x, np.int64) for x in table["data"].to_pylist())
        return table.slice(0, 1).set_column(3, "data", pa.array([press(total)], pa.binary()))

    schema = "part int, k int, at long, data binary"
    parts = materialize(_rows(table, tree, table_bits, task, schema), "counts")
    top = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        top = -(-top // 32)
        old, parts = parts, materialize(parts.withColumn("part", F.floor(F.col("part") / 32).cast("int")).groupBy("part", "k", "at").applyInArrow(fold, schema), "counts")
        discard(old)
        if top == 1:
            break
    tables = [np.zeros(2 << bits, np.float32) for bits in table_bits]
    for r in parts.collect():  # the size of the tables, whatever the corpus
        tables[r["k"]][r["at"] : r["at"] + PIECE] = unpress(r["data"], np.int64)
    discard(parts)
    return tables


def _fit(table: DataFrame, tree: Tree, table_bits: tuple[int, ...], counts) -> Mixer:
    """A mixer learned over all training texts: each task's is averaged by its curvature, their maps are summed. ``counts`` is the broadcast tables."""

    def task(found, number):
        mixer, curve = Mixer(), np.zeros((GATES, ORDERS + 1, ORDERS + 1))
        tables = [t.view(np.complex64) for t in counts.value]

        def others(k, slots, y):
            """The logit without the bit's own occurrence, and how often the context was seen elsewhere."""
            n = tables[k][slots]
            n0, n1 = np.maximum(n.real - (y == 0), 0), np.maximum(n.imag - (y == 1), 0)
            return logit(n0, n1), n0 + n1

        for bits, n in found:
            x, y = np.ones((ORDERS + 1, len(bits.of)), np.float32), bits.y
            for k, s in enumerate(bits.slots):
                own, total = others(k, s, y)
                x[k] = own[bits.at]
                if k == 3:
                    sure = confidence(total)[bits.at]
            y = y[bits.at]
            for k, which, s in bits.reach:
                x[k, which], total = others(k, s, y[which])
            sure[bits.reach[1][1]] = confidence(total)
            x[5], total = others(5, bits.joint, y)
            mixer.learn(x.T, y, confidence(total) * CONFIDENCE + sure, n[bits.of].astype(np.float32), curve)
        pulled = np.einsum("gij,gj->gi", curve, mixer.weights)
        yield pa.RecordBatch.from_arrays([pa.array(range(GATES), pa.int32()), *[pa.array(list(a.reshape(GATES, -1)), pa.list_(pa.float64())) for a in (curve, pulled, mixer.seen)]], names=["gate", "curve", "pulled", "seen"])

    made = materialize(_rows(table, tree, table_bits, task, "gate int, curve array<double>, pulled array<double>, seen array<double>"), "mixers")
    sizes = (("curve", (ORDERS + 1) ** 2), ("pulled", ORDERS + 1), ("seen", 2 * BUCKETS))
    sums = made.groupBy("gate").agg(*[F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(c) for c, n in sizes]).collect()
    mixer = Mixer()
    for r in sums:
        curve = np.array(r["curve"]).reshape(ORDERS + 1, ORDERS + 1)
        mixer.weights[r["gate"]] = np.linalg.solve(curve + np.eye(ORDERS + 1), np.array(r["pulled"]) + mixer.weights[r["gate"]])
        mixer.seen[r["gate"]] = np.array(r["seen"]).reshape(BUCKETS, 2)
    discard(made)
    return mixer


def _score(table: DataFrame, held) -> DataFrame:
    """The slices' documents with their scores: each pair's log10 probability under the broadcast model ``held``, added up by the documents' counts."""

    def run(batches):
        for b in slices(batches, 1):
            row = {c: b.column(c)[0].as_py() for c in ("firsts", "seconds", "learned", "text", "places", "counts", "ends")}
            units = _units(row, False)
            lp = units.of_pairs(held.value.of_units(units))
            del units
            each = unpress(row["counts"], np.int64) * lp[unpress(row["places"], np.int32)]
            found = [float(each[a:z].sum()) for a, z in zip(row["ends"], row["ends"][1:], strict=False)]
            del row, lp, each
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in SCORED), pa.array([found])], names=[*SCORED, "score"])

    whole = table.where("ids is not null").select(*WHOLE)
    types = dict(whole.dtypes)
    return whole.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in SCORED) + ", score array<double>")


SCORED = ("slice", "ids", "train", "bytes", "ends", "places", "counts", "seconds")


def _assemble(scored: DataFrame, back: DataFrame, known: tuple[int, int], id_kind: str) -> DataFrame:
    """Texts' rows: each slice gets its words' counts back, and adds up the base by its documents' counts. ``known``: training tokens and distinct ones."""
    total, distinct = known
    log_base = np.log10(total + 0.5 * (distinct + 1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        r = {c: left[c].combine_chunks() for c in left.column_names}
        flat = {c: r[c].flatten().to_numpy(zero_copy_only=False) for c in ("train", "bytes", "ends", "score")}
        place = right["place"].to_numpy()
        c = np.zeros(len(place), np.int64)
        c[place] = right["c"].to_numpy()
        word, n = unpress(r["seconds"][0].as_py(), np.int32)[unpress(r["places"][0].as_py(), np.int32)], unpress(r["counts"][0].as_py(), np.int64)
        starts = flat["ends"]
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[starts])
        each = n * (np.log10(c + 0.5) - log_base)[word]
        base = np.array([each[a:b].sum() for a, b in zip(starts, starts[1:], strict=False)])
        score, size = flat["score"], flat["bytes"]
        per_byte = pa.array(-score * np.log2(10) / np.maximum(size, 1), mask=size == 0)
        columns = [r["ids"].flatten(), pa.array(~flat["train"].astype(bool)), pa.array(sums(n)), pa.array(sums(n * (c > 0)[word])), pa.array([total] * len(size), pa.int64()), pa.array(base), pa.array(score), per_byte]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return scored.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(run, f"doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def language_model_scores(
    docs: DataFrame, *, table_bits: tuple[int, ...] = (12, 18, 20, 20, 21, 22), words_per_slice: int = 300_000, entries: int = 1_500_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for every row.

    ``base_score`` is the log10 probability of the tokens, the end among them, by their counts plus one half over all training tokens; ``score`` the
    context-mixing model's. ``table_bits``: the sizes of the tables, as powers of two, for the place in the word, one, two and four bytes, the prefix,
    and the prefix with the word before.
    """
    spark, kind = docs.sparkSession, id_type(docs, id_col)
    table = materialize(cut(docs, id_col, text_col, words_per_slice, entries), "slices")
    facts = table.where("ids is not null").agg(*[F.sum(F.col("histogram")[i]).alias(f"h{i}") for i in range(256)], F.count("*").alias("slices")).first()
    tree = Tree([facts[f"h{i}"] or 0 for i in range(256)])
    # Slices have summed their words, so one exchange, by the word alone, serves their counts and the way back: a row lists where at most some ``PART``
    # slices have the word.
    words = table.where("word is not null").select("word", "n", F.struct("slice", "place").alias("at"), F.pmod(F.xxhash64("slice"), F.lit(max(1, facts["slices"] // PART))).alias("part"))
    grouped = words.repartition("word").groupBy("word", "part").agg(F.sum("n").alias("m"), F.collect_list("at").alias("at"))
    if facts["slices"] < 2 * PART:  # one part
        counted = grouped.select("at", F.col("m").alias("c"), F.lit(True).alias("new"))
    else:
        by_word = Window.partitionBy("word")
        counted = grouped.select("at", F.sum("m").over(by_word).alias("c"), (F.row_number().over(by_word.orderBy("part")) == 1).alias("new"))
    vocab = materialize(counted, "vocabulary")
    tokens, distinct = vocab.where("new").agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    counts = _count(table, tree, table_bits)
    shared = spark.sparkContext.broadcast(counts)
    model = Model(tree, table_bits, counts, _fit(table, tree, table_bits, shared))
    shared.destroy()
    del counts
    back = vocab.select("c", F.explode("at").alias("at")).select("at.slice", "at.place", "c")
    return _assemble(_score(table, spark.sparkContext.broadcast(model)), back, (tokens, distinct), kind)
