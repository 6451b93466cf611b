"""Centroid clustering, hard negatives and language-model scores."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from pointmill.llm import centroids, context_mixing, hard_negatives, queries, vector_sql

NAN, INF = float("nan"), float("inf")


def plain_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    nearest = lambda v: min((far(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    return [(i, j, d, sum(e for _, e, m in found if m == j), sum(e for _, e, _ in found), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found]


def vectors(seed, n, dims, low=-1.0, high=1.0):
    rng = random.Random(seed)
    return [[rng.uniform(low, high) for _ in range(dims)] for _ in range(n)]


@pytest.mark.parametrize("bits,k", [(1, 5), (4, 5), (8, 3), (6, 40)])
def test_clusters_equal_brute_force(spark, bits, k):
    rows = list(enumerate(vectors(bits, 60, 3))) + [(100 + i, [0.5, 0.5, 0.5]) for i in range(30)] + [(7, [0.1, 0.2, 0.3])] * 2
    rows += [(200, None), (201, [0.1, None, 0.2]), (202, [NAN, 0.0, 0.0]), (203, [INF, 0.0, 0.0]), (204, [0.1, 0.2]), (205, []), (None, [0.3, 0.1, -0.2])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, key string, cluster int").repartition(3)
    got = centroids.cluster_vectors(df, k=k, dims=3, bits=bits)
    single = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_clusters(single, k, 3, 3, 64)))


def test_cells_bound_distances():
    rng = np.random.default_rng(3)
    v = rng.integers(-300, 300, (200, 5))
    v[:, 4] = 7
    for bits in (1, 3, 8):
        cells = centroids.Cells(v.min(axis=0), v.max(axis=0), bits)
        codes, c = cells.encode(v), rng.integers(-400, 400, (6, 5))
        low, high = cells.intervals(codes, c)
        exact = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        assert (low <= exact).all() and (exact <= high).all() and len(codes[0]) == math.ceil(5 * bits / 8)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster_vectors(spark.createDataFrame([], schema)).collect() == []
    assert centroids.cluster_vectors(spark.createDataFrame([(1, None), (2, [1.0])], schema)).collect() == []
    huge = centroids.cluster_vectors(spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.0, 0.0])], schema), k=1, dims=2).collect()
    assert sorted((r["vec_id"], r["cluster"]) for r in huge) == [(1, 0), (2, 0)]


def plain_negatives(rows, take=5, least=3, every=50, scale=256):
    dims = max((len(v) for _, v, _ in rows if v), default=0)
    ok = [(i, [math.floor(scale * x) for x in v] + [0] * (dims - len(v)), y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, a, y) in enumerate(ok):
        if i % every:
            continue
        score = [sum(p * q for p, q in zip(a, v, strict=True)) for _, v, _ in ok]
        near = sorted((-score[m], j) for m, (j, _, z) in enumerate(ok) if m != n and z == y)[:take]
        for s, j in near:
            fit = sorted((-score[m], o) for m, (o, _, z) in enumerate(ok) if z != y and -50 * s <= 100 * score[m] <= -95 * s)[:least]
            out += [(i, j, r, o, -s, -t) for r, (t, o) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["random", "clusters", "positive", "same"])
def test_negatives_equal_brute_force(spark, shape):
    rng = random.Random(5)
    dims = 6
    spots = vectors(1, 8, dims)
    make = {"random": lambda: [rng.uniform(-1, 1) for _ in range(dims)], "clusters": lambda: [x + rng.uniform(-0.05, 0.05) for x in rng.choice(spots)], "positive": lambda: [rng.random() for _ in range(dims)], "same": lambda: [0.5] * dims}[shape]
    rows = [(i, make(), rng.randrange(3)) for i in range(400)] + [(50, make(), 1), (50, make(), 1), (51, spots[0], 0)]
    rows += [(500, None, 1), (550, [NAN] * dims, 1), (600, make(), None), (None, make(), 1), (650, [0.3, None], 1), (700, [0.4, 0.5], 1), (750, [], 2), (800, make(), 99)]
    df = spark.createDataFrame([(i, v, y, "x", 0) for i, v, y in rows], "vec_id long, embedding array<float>, label int, key string, cell int").repartition(3)
    got = hard_negatives.hard_negatives(df, words=4, sample_rows=64, block=16, chunk=5, first=32, growth=2)
    single = [(i, v and [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    assert sorted(map(tuple, got.collect())) == plain_negatives(single)


def test_walk_visits_cells_by_falling_bound():
    rng = np.random.default_rng(2)
    v = np.floor(256 * rng.normal(size=(500, 8)))
    index = hard_negatives.Index([hard_negatives.fit_half(v[:, :4], 5), hard_negatives.fit_half(v[:, 4:], 5)])
    cell, far0, far1 = index.cells_of(v)
    index.measure([(int(c), int((cell == c).sum()), far0[cell == c].max(), far1[cell == c].max()) for c in np.unique(cell)], 16)
    for a in v[:20]:
        steps, score = list(index.walk(a)), v @ a
        assert sorted(c for *_, c in steps) == sorted(np.unique(cell)) and [u for u, *_ in steps] == sorted((u for u, *_ in steps), reverse=True)
        assert all(low <= score[cell == c].min() and score[cell == c].max() <= up for up, low, c in steps)


def test_search_stops_when_certified(spark):
    """Well separated clusters: an anchor asks for the blocks of its own one only."""
    rng = np.random.default_rng(4)
    v = np.concatenate([np.eye(4)[i % 4] * 1000 + rng.normal(size=4) for i in range(400)]).reshape(400, 4).astype(int)
    index = hard_negatives.Index([hard_negatives.fit_half(v[:, :2].astype(float), 3), hard_negatives.fit_half(v[:, 2:].astype(float), 3)])
    cell, far0, far1 = index.cells_of(v.astype(float))
    index.measure([(int(c), int((cell == c).sum()), far0[cell == c].max(), far1[cell == c].max()) for c in np.unique(cell)], 1000)
    rows = [(n, 0, v[n].tolist(), [(0, -(2**62), 2**62, 990_000)]) for n in range(4)]
    asks = hard_negatives._asks(spark.createDataFrame(rows, f"key long, label int, v array<int>, lists {hard_negatives.LISTS}"), index, 0, 400, 1)
    assert sorted((r["key"], r["cell"]) for r in asks.collect()) == [(n, cell[n]) for n in range(4)]


def test_no_anchors_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.hard_negatives(spark.createDataFrame([], schema)).collect() == []
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1), (3, [1.0], 2)], schema)).collect() == []
    assert hard_negatives.hard_negatives(spark.createDataFrame([(50, [1.0], 1)], schema)).collect() == []


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_hard_negatives"])
def test_vector_queries_equal_sql(spark, duck, sf, name):
    df = queries.queries()[name](spark, sf)
    want = duck.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols and vector_sql
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


TABLES = (12, 14, 14, 14, 14, 14)


def plain_base(rows):
    tokens = lambda t: [w.decode() for w in re.compile(rb"[^\x20\x09-\x0D]+").findall((t or "").encode().lower())] + [None]
    train = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        w = tokens(t)
        out.append((str(i), i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)))
    return sorted(out)


def test_language_model_base_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(50).collect()]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "The THE tHe École École"), (1003, "The THE tHe École École"), (None, "null id"), (1004, "long " * 30_000 + "x" * 20_000), (1005, "a\x00b\x1fc d")]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    for how in ({}, {"words_per_slice": 40, "entries": 100}):
        got = context_mixing.language_model_scores(df, table_bits=TABLES, **how).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == plain_base(rows)
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
        twins = {round(r["score"], 6) for r in got if r["doc_id"] == 1003}
        assert len(twins) == 1 and all(r["bits_per_byte"] is None for r in got if r["doc_id"] in (1000, 1001))


def small_model():
    rng = random.Random(1)
    words = ["".join(rng.choice(["an", "th", "er", "ti"]) for _ in range(rng.randrange(1, 4))).encode() for _ in range(300)] + [b""] * 5
    classes, n = np.array([rng.randrange(2) for _ in words]), np.ones(len(words), int)
    tree = context_mixing.Tree(np.bincount(np.frombuffer(b" ".join(words), np.uint8), minlength=256).tolist())
    counts = [np.zeros(2 << b, np.float32) for b in TABLES]
    plain = [Counter() for _ in TABLES]
    for of, y, slots in context_mixing.decisions(tree, TABLES, words, classes, 64):
        for k in range(context_mixing.ORDERS):
            np.add.at(counts[k], slots[k] * 2 + y, n[of])
            plain[k].update((slots[k] * 2 + y).tolist())
    assert all(counts[k][s] == m for k in range(len(TABLES)) for s, m in plain[k].items())
    mixer, curve = context_mixing.Mixer(), np.zeros((context_mixing.GATES, 7, 7))
    for of, y, slots in context_mixing.decisions(tree, TABLES, words, classes):
        x = np.column_stack([*[context_mixing.logit(counts[k][slots[k] * 2], counts[k][slots[k] * 2 + 1]) for k in range(6)], np.ones(len(y))])
        mixer.learn(x, y, np.full(len(y), 9), n[of].astype(float), curve)
    return context_mixing.Model(tree, TABLES, counts, mixer, np.full(16, 1 / 16)), words, classes


def test_probabilities_of_all_continuations_add_up_to_one():
    model, _, _ = small_model()
    for start in (b"", b"an", b"anth", "é".encode()):
        # A word's probability is the product over its bytes and the space: what follows `start` and one byte more, summed over all bytes, is one.
        def after(words):
            """log10 of the probability of the bytes without the closing space."""
            end = [w + b" " for w in words]
            bits = [(of, y, s) for of, y, s in context_mixing.decisions(model.tree, TABLES, words, np.zeros(len(words), int), 10**9)]
            of, y, slots = bits[0]
            x = np.column_stack([*[model.logits[k][slots[k]] for k in range(6)], np.ones(len(y))])
            gate = model.sure[1][slots[5]].astype(int) * 8 + model.sure[0][slots[3]]
            p = model.mixer.refine(model.mixer.mix(x, gate), gate)
            p = np.where(y == 1, p, 1 - p)
            keep = np.concatenate([np.arange(sum(model.tree.length[c] for c in w)) < sum(model.tree.length[c] for c in w[:-1]) for w in end])
            return np.bincount(of[keep], weights=np.log(p[keep]), minlength=len(words))

        whole = np.exp(after([start + bytes([b]) for b in range(256)]))
        one = np.exp(after([start])[0]) if start else 1.0
        assert whole.sum() == pytest.approx(one, rel=1e-9)


def test_model_prefers_words_like_those_it_learned():
    model, words, classes = small_model()
    known = model(words, classes)
    assert (model([b"zqxj", b"\xff\xfe"], np.array([0, 0])) < known.min()).all()
    assert model([b"thanti"], np.array([0]))[0] > model([b"tahnit"], np.array([0]))[0]
    assert np.allclose(known[:7], np.concatenate([model([w], np.array([c])) for w, c in zip(words[:7], classes[:7], strict=True)]))


def test_language_model_beats_its_base_on_held_out_texts(spark, sf):
    rows = context_mixing.language_model_scores(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")).where("held_out").collect()
    typical = [r for r in rows if r["n_known"] > 0.9 * r["n_tokens"]]
    assert len(typical) > 50 and sum(r["score"] for r in typical) > sum(r["base_score"] for r in typical)


def test_language_model_reads_words_in_order(spark):
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1][:60]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(i, "alpha beta gamma delta " * 5) for i in train] + [(held[0], "alpha beta gamma delta"), (held[1], "delta gamma beta alpha")]
    got = {r["doc_id"]: r for r in context_mixing.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string"), table_bits=TABLES).collect()}
    like, other = got[held[0]], got[held[1]]
    assert like["base_score"] == pytest.approx(other["base_score"]) and like["score"] > other["score"] + 3
    # Bytes of the word before stand in the contexts of the next one, as far back as the last three.
    tree = context_mixing.Tree([1] * 256)
    slots = lambda w: next(context_mixing.decisions(tree, TABLES, [b"a"], np.array([context_of(w)])))[2][:, 0].tolist()
    context_of = context_mixing.context_of
    same = [[a == b for a, b in zip(slots(b"xabc"), slots(w), strict=True)] for w in (b"yabc", b"zbc", b"xabd")]
    assert same == [[True, True, True, True, True, False], [True, True, True, False, True, False], [True, True, False, False, True, False]]


def test_language_model_works_once_on_what_pairs_share_in_bounded_memory():
    rng = np.random.default_rng(3)
    words = [b""] + list(dict.fromkeys(bytes(rng.choice(list(b"abcdefgh"), rng.integers(1, 9)).tolist()) for _ in range(3000)))
    code = np.unique(rng.integers(0, len(words), 40_000) << 32 | rng.integers(0, 300, 40_000))
    seconds, firsts, n = (code >> 32).astype(np.int32), (code & 0xFFFFFFFF).astype(np.int32), rng.integers(0, 4, len(code))
    knows, text = np.array([context_mixing.context_of(w) for w in words]), np.frombuffer(b" ".join(words) + b" ", np.uint8)
    tree = context_mixing.Tree(np.bincount(text, minlength=256).tolist())
    tracemalloc.start()
    units = context_mixing.Units(text, seconds, firsts, knows, n)
    counts = [np.zeros(2 << b, np.float32) for b in TABLES]
    for a, z, bits in units.pieces(tree, TABLES):
        slots = np.stack([*(s[bits.at] for s in bits.slots), bits.joint])
        for k, which, own in bits.reach:
            slots[k, which] = own
        for k in range(context_mixing.ORDERS):
            np.add.at(counts[k], slots[k] * 2 + bits.y[bits.at], units.n[a:z][bits.of])
    model = context_mixing.Model(tree, TABLES, counts, context_mixing.Mixer())
    got = units.of_pairs(model.of_units(units))
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    plain, log10 = [np.zeros(2 << b, np.float32) for b in TABLES], np.zeros(len(code))
    for of, y, slots in context_mixing.decisions(tree, TABLES, [words[i] for i in seconds], knows[firsts]):
        x = np.column_stack([*[model.logits[k][slots[k]] for k in range(6)], np.ones(len(y))])
        gate = model.sure[1][slots[5]].astype(int) * 8 + model.sure[0][slots[3]]
        p = model.mixer.refine(model.mixer.mix(x, gate), gate)
        np.add.at(log10, of, np.log10(np.where(y == 1, p, 1 - p)))
        for k in range(context_mixing.ORDERS):
            np.add.at(plain[k], slots[k] * 2 + y, n[of])
    assert all(np.array_equal(a, b) for a, b in zip(counts, plain, strict=True)) and np.allclose(got, log10, atol=1e-4)
    size = np.array([len(w) + 1 for w in words])
    assert np.where(units.start < 3, 1, size[units.seconds] - 3).sum() < size[seconds].sum() / 2


def test_language_model_counts_past_what_a_table_holds(spark):
    words, pairs = [b"", b"ab", b"abcde"], np.array([(1, 0), (2, 0), (0, 1), (2, 1)], np.int32)
    press, n = context_mixing.press, np.array([5, 70_000, 3, 1 << 33])
    row = tuple(bytearray(press(x)) for x in (pairs[:, 1].copy(), pairs[:, 0].copy(), n, np.frombuffer(b" ".join(words), np.uint8)))
    df = spark.createDataFrame([([1], *row)], "ids array<long>, firsts binary, seconds binary, learned binary, text binary")
    got = context_mixing._count(df, context_mixing.Tree([1] * 256), TABLES, 1 << 28)
    want = [np.zeros(2 << b) for b in TABLES]
    for of, y, slots in context_mixing.decisions(context_mixing.Tree([1] * 256), TABLES, [words[i] for i in pairs[:, 0]], np.array([context_mixing.context_of(words[i]) for i in pairs[:, 1]])):
        for k in range(context_mixing.ORDERS):
            np.add.at(want[k], slots[k] * 2 + y, n[of])
    assert all(np.allclose(a, b, rtol=1e-6) for a, b in zip(got, want, strict=True))


def test_language_model_without_texts(spark):
    schema = "doc_id long, text string"
    assert context_mixing.language_model_scores(spark.createDataFrame([], schema), table_bits=TABLES).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = context_mixing.language_model_scores(spark.createDataFrame([(held, "a b")], schema), table_bits=TABLES).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and math.isfinite(r["score"])
