"""Deduplication, decontamination, classifiers and the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pointmill.llm import decontamination, quality_ranking, quality_rules, secrets, simhash, spm, substring_dedup, toxicity
from pointmill.llm.learning import logistic_fit, sigmoid

ROWS = "doc_id long, text string"
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a b " * 4000), (5, "a b " * 4000), (None, "null id"), (6, "é日本😀 ́x")]


def plain_fingerprint(text, k):
    words = [w.decode() for w in text.lower().encode().split()] if text.isascii() else [w.decode() for w in text.encode().lower().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, i in enumerate(ids):
        for m in range(n):
            if (prints[n] ^ prints[m]).bit_count() <= radius:
                a, b = find(i), find(ids[m])
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + EDGE
    df = spark.createDataFrame(rows, ROWS)
    got = simhash.fingerprints(df).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("h"), F.col("fp")).collect()
    assert sorted((str(r["doc_id"]), r["h"]) for r in got) == sorted((str(i), f"{plain_fingerprint(t or '', 3):016x}") for i, t in rows)
    native = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s")).first()[0]
    assert native & (1 << 64) - 1 == xxhash.xxh64(b"a b c", seed=42).intdigest()


@pytest.mark.parametrize("radius,crowd", [(1, 1024), (2, 1024), (2, 2), (3, 1024), (3, 2), (1, 2)])
def test_links_connect_what_brute_force_connects(spark, radius, crowd):
    rng = random.Random(radius * 10 + crowd)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in list(prints[:25]):
        q = p
        for _ in range(rng.randint(1, 5)):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                q ^= 1 << b
            prints.append(q)
    prints = sorted(set(prints)) + [0, 1, 3, (1 << 64) - 1, (1 << 64) - 2]
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius=radius, crowd=crowd)
    pairs = [(r["a"], r["b"]) for r in edges.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= radius for a, b in pairs)
    up = {s: s for s in signed}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(find(a), find(b))] = min(find(a), find(b))
    assert {s: find(s) for s in signed} == plain_components(signed, [s & (1 << 64) - 1 for s in signed], radius) or _same_groups({s: find(s) for s in signed}, plain_components(signed, [s & (1 << 64) - 1 for s in signed], radius))


def _same_groups(a, b):
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    return groups(a) == groups(b)


def test_near_duplicate_components(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choices("abcdefghij", k=400)) for _ in range(6)]
    rows = [(10 + i, t) for i, t in enumerate(base)] + [(30 + i, t) for i, t in enumerate(base)] + [(50, base[0] + " end"), (8, base[1].upper()), *EDGE]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, ROWS)).collect()}
    assert got[30] == 10 and got[11] == got[31] == 8 and got[2] == got[3] == 1 and got[None] is None
    kept = simhash.keep_one(spark.createDataFrame(rows, ROWS)).collect()
    assert {r["doc_id"] for r in kept} >= {10, 8, 1, None} and not {30, 31, 3, 2} & {r["doc_id"] for r in kept}
    assert simhash.near_duplicates(spark.createDataFrame([], ROWS)).count() == 0


def plain_groups(ids, texts, radius=2, least=0.8):
    """Components by fingerprints within the radius or five-word similarity, by comparing all pairs."""
    prints = {i: plain_fingerprint(texts[i] or "", 5) for i in ids}
    bags = {i: {tuple(w[k : k + 5]) for w in [(texts[i] or "").encode().lower().split()] for k in range(max(1, len(w) - 4))} for i in ids}
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(bags[i] & bags[j])
            if (prints[i] ^ prints[j]).bit_count() <= radius or both >= least * (len(bags[i]) + len(bags[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_copies_of_similarity_0_8(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    rows, groups = [], {}
    for g in range(30):
        base = [word() for _ in range(rng.randint(120, 400))]
        if g % 3 == 0:
            base += passage.split()
        for c in range(4):
            copy = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) // 120) if c else 0):
                copy[at] = word()
            groups[g * 10 + c] = g * 10
            rows.append((g * 10 + c, " ".join(copy)))
    rows.append((999, passage))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, ROWS), shingle=5, least_similarity=0.8).collect()}
    assert got == groups | {999: 999}


def test_all_pairs_of_similarity_0_8_among_short_texts_and_under_a_frequent_passage(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 9)))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(20, 60))]
        texts += [base, base[:-1] + [word()], base + [word()], [word()] + base, base[: len(base) // 2] + [word()] + base[len(base) // 2 :]]
    for _ in range(1200):
        own = [word() for _ in range(rng.randint(2, 14))]
        texts += [passage + own] + ([passage + own[:-1] + [word()]] if rng.random() < 0.1 else [])
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    bags = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    prints = [plain_fingerprint(t, 5) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(bags[i] & bags[j])
            if both / (len(bags[i]) + len(bags[j]) - both) >= 0.8 or (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, ROWS), shingle=5, least_similarity=0.8).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def plain_removal(texts, length):
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, dtype=np.uint8)[~gone])).hexdigest()))
    return out


def test_substring_removal_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdef é", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(40) for _ in range(4)]
    texts = [prose(30) + rng.choice(shared) + prose(30) for _ in range(25)] + ["x" * 700, "ab" * 300, "x" * 199, "x" * 200, prose(60) * 2, None, ""]
    texts += [texts[0], shared[0], shared[1][:250]]
    rows = list(enumerate(texts)) + [(None, texts[1]), (0, texts[0])]
    df = spark.createDataFrame([(i, t, 1, b"x", 2) for i, t in rows], "doc_id long, text string, gram int, t binary, spans int")
    want = plain_removal([(t or "").encode() for _, t in rows], 200)
    assert sorted(map(str, (tuple(r) for r in substring_dedup.digests(df).collect()))) == sorted(map(str, ((i, *w) for (i, _), w in zip(rows, want, strict=True))))
    named = substring_dedup.digests(df.select(F.concat(F.lit("n"), "doc_id").alias("doc_id"), "text")).collect()
    assert sorted(map(str, (tuple(r)[1:] for r in named))) == sorted(map(str, want))


def test_substring_removal_in_a_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"{rng.choice('bcdfgh')}{rng.getrandbits(20):x}" for _ in range(70)]
    rows = []
    for i in range(5000):
        own = list(base)
        for at in rng.sample(range(70), rng.randint(0, 3)):
            own[at] = f"w{rng.getrandbits(24):x}"
        rows.append((None if i % 3 else i, " ".join(own)))
    got = substring_dedup.digests(spark.createDataFrame(rows, ROWS)).collect()
    want = plain_removal([t.encode() for _, t in rows], 200)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, ((i, *w) for (i, _), w in zip(rows, want, strict=True))))


def test_rows_without_id_are_told_apart(spark):
    rng = random.Random(3)
    twin = "".join(rng.choices("abcdefgh ", k=320))
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"))
    rows = rows.union(spark.createDataFrame([(None, twin), (None, "".join(rng.choices("abcdefgh ", k=320))), (None, "x" + twin)], ROWS))
    assert [tuple(r) for r in substring_dedup.digests(rows).where("n_removed > 0").select("n_bytes", "n_removed").orderBy("n_bytes").collect()] == [(320, 320), (321, 320)]


def test_parse_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 101, 5000, dtype=np.uint8))
    whole = substring_dedup.parse(text)
    assert whole[1].sum() == len(text) - 199
    monkeypatch.setattr(substring_dedup, "BLOCK", 700)
    cut = substring_dedup.parse(text)
    assert cut[1].sum() == len(text) - 199 and set((cut[0] + cut[2]).tolist()) == set((whole[0] + whole[2]).tolist())


def test_removal_of_nothing(spark):
    assert substring_dedup.digests(spark.createDataFrame([], ROWS)).count() == 0
    got = substring_dedup.digests(spark.createDataFrame([(1, "short"), (2, None)], ROWS)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (2, 0)]


def test_decontamination(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randint(15, 60)) + ".") for i in range(30)] + [(90, None), (91, ""), (92, "tiny item")]
    near = items[3][1].split()
    near[len(near) // 2] = "changed"
    rows = [(200 + i, prose(50) + " " + items[i][1].upper() + "\n" + prose(50)) for i in range(20)] + [(50 + i, prose(120)) for i in range(30)]
    rows += [(100, prose(30) + " " + " ".join(near) + " " + prose(9)), (101, " ".join(items[5][1].split()[:8]) + " " + prose(60)), (102, "so tiny item here"), *EDGE]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(spark.createDataFrame(rows, ROWS), bench).collect()}
    weights = decontamination.item_weights(bench)
    h = lambda t: decontamination.shingle_hashes(t.encode())[0]
    expect_near = decontamination.weighted_similarity(h(" ".join(near)), h(items[3][1]), weights) >= 0.8
    assert got == {(200 + i, i) for i in range(20)} | {(102, 92)} | ({(100, 3)} if expect_near else set())
    kept = {r["doc_id"] for r in decontamination.drop_contaminated(spark.createDataFrame(rows, ROWS), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}
    assert decontamination.contaminated(spark.createDataFrame(rows, ROWS), bench.where("item_id < 0")).count() == 0
    assert decontamination.contaminated(spark.createDataFrame([], ROWS), bench).count() == 0


def plain_windows(rows, items, weights):
    """Every window of every document against every item, without any index."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    bag = lambda ws: decontamination.shingle_hashes(" ".join(ws).encode(), 5)[0]
    found = {}
    for d, text in rows:
        own = words(text)
        for i, item in items:
            its = words(item)
            if not own or not its:
                continue
            size = min(len(its), len(own))
            scores = [(decontamination.weighted_similarity(bag(own[b : b + size]), bag(its), weights), -b) for b in range(len(own) - size + 1)]
            s, b = max((round(s, 9), b) for s, b in scores)
            if s >= 0.8:
                found[d, i] = (-b, s)
    return found


def test_decontamination_against_every_window(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    prose = lambda n: [word() for _ in range(n)]
    header = prose(12)
    items = [(i, header + prose(rng.randint(10, 60))) for i in range(8)] + [(20 + i, prose(rng.randint(10, 120))) for i in range(7)]
    items += [(40, items[12][1]), (41, prose(3)), (42, prose(4)), (43, prose(5))]
    rows = [(1, prose(60))]
    for k, (_, ws) in enumerate(items):
        half = len(ws) // 2
        odd = list(ws)
        odd[rng.randrange(len(ws))] = "changed"
        rows += [(100 + k, prose(30) + ws[half:] + ws[:half] + prose(30)), (200 + k, prose(20) + odd + prose(20)), (300 + k, ws[: max(1, len(ws) * 9 // 10)]), (400 + k, header + prose(40)), (500 + k, prose(7) + ws + ws)]
    items = [(i, " ".join(ws)) for i, ws in items]
    rows = [(i, " ".join(ws)) for i, ws in rows] + [(9, "tiny"), *EDGE]
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, similarity double")
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, item_id int, bits int")
    weights = decontamination.item_weights(bench)
    want = plain_windows([r for r in rows if r[0] not in (5, None)], items, weights)
    for size in (8 << 20, 900):
        got = {(r["doc_id"], r["item_id"]): (r["first_word"], round(r["similarity"], 9)) for r in decontamination.contaminated(docs, bench, group_bytes=size).collect()}
        assert got == want
    assert len({d for d, _ in want}) > 50


def test_hamming_blocks_find_all_within_the_radius():
    rng = random.Random(9)
    weights = decontamination.Weights(200, np.ones(decontamination.BUCKETS))
    index = decontamination.ItemIndex([(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(20))) for i in range(200)], 5, 19, weights)
    for _ in range(200):
        fp = index.prints[rng.randrange(200)]
        for b in rng.sample(range(64), rng.randint(0, 22)):
            fp ^= 1 << b
        assert index.near(fp) == {k for k, p in enumerate(index.prints) if (fp ^ p).bit_count() <= 19}


@pytest.mark.parametrize("header, changed", [(400, 1), (800, 3), (1500, 6)])
def test_no_link_is_lost_to_a_common_header(header, changed):
    """Items that share a header of light shingles: neither its changed words, unknown to all items, nor one of an item's few own words leads a similar window beyond the radius."""
    rng = random.Random(header)
    top = [f"h{i}" for i in range(header)]
    items = [" ".join(top + [f"w{rng.randrange(10**7)}" for _ in range(10)]) for _ in range(300)]
    bags = [decontamination.shingle_hashes(t.encode())[0] for t in items]
    counts = np.zeros(decontamination.BUCKETS, dtype=np.int64)
    for bag in bags:
        counts[np.unique(bag % np.uint64(decontamination.BUCKETS)).astype(np.int64)] += 1
    weights = decontamination.Weights(len(items), counts)
    index = decontamination.ItemIndex(list(enumerate(items)), 5, 19, weights)
    similar = 0
    for _ in range(60):
        k = rng.randrange(len(items))
        words = items[k].split()
        for at in rng.sample(range(header), changed) if rng.random() < 0.5 else [rng.randrange(header, header + 10)]:
            words[at] = f"x{rng.randrange(10**7)}"
        window = decontamination.shingle_hashes(" ".join(words).encode())[0]
        if decontamination.weighted_similarity(window, bags[k], weights) >= 0.8:
            similar += 1
            assert k in index.near(decontamination.simhash(window, weights))
    assert similar >= 20


def test_a_ledger_that_holds_most_blobs_moves_no_other_text(spark, tmp_path):
    """Nothing is read again when all blobs are known; a few new ones are picked by broadcast hashes below the only exchange of texts."""
    ledger = str(tmp_path / "ledger")
    old = [(i, f"text {i % 30} password = abcdefghijkl{i % 30:02d}") for i in range(60)]
    version = secrets.version_of(secrets.RULES)
    unseen = lambda rows: secrets._unseen(spark.createDataFrame(rows, ROWS), ledger, version, "doc_id", "text")
    secrets.scan_unseen(spark.createDataFrame(old, ROWS), ledger)
    assert spark.read.parquet(ledger).count() == 30 and unseen(old) is None
    new = [*old, (77, "token: 0123456789abcdef"), (77, "token: 0123456789abcdef"), (78, "token: 0123456789abcdef"), (79, None)]
    got = unseen(new)
    plan = got._jdf.queryExecution().executedPlan().toString().split("\n")
    texts = [n for n, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    assert len(texts) == 1 and texts[0] < next(n for n, line in enumerate(plan) if "BroadcastHashJoin" in line)
    assert sorted(r["text"] for r in got.collect()) == ["", "token: 0123456789abcdef"]
    found = {r["doc_id"]: len(r["spans"]) for r in secrets.findings(spark.createDataFrame(new, ROWS), ledger).collect()}
    assert spark.read.parquet(ledger).count() == 32 and found[79] == 0 and found[77] == found[78] == 2 and found[5] == 1


def _labelled(spark, make, n=400):
    rows = [(i, *make(i)) for i in range(n)]
    return spark.createDataFrame([(i, t) for i, t, _ in rows], ROWS), spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_quality_ranking_separates(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_ranking.fit_from(docs, labels)
    r = quality_ranking.quality_scores(docs, model).join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert r > 0.93
    again = quality_ranking.fit_from(docs, labels)
    assert np.allclose(model.weights, again.weights)
    edge = quality_ranking.quality_scores(spark.createDataFrame(EDGE, ROWS), model).collect()
    assert len(edge) == len(EDGE) and all(0 <= x["score"] <= 1 for x in edge)
    none = quality_ranking.fit_from(docs, labels.where("quality = 1"))
    assert {x["score"] for x in quality_ranking.quality_scores(docs, none).select("score").collect()} == {0.5}


def test_pairs_and_fit():
    g, b = quality_ranking.preference_pairs(5, 3, 20)
    assert len(set(zip(g.tolist(), b.tolist(), strict=True))) == 15
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < sigmoid(x @ [2.0, -1.0] + 0.5)).astype(float)
    assert np.allclose(logistic_fit(x, y), [2.0, -1.0, 0.5], atol=0.3)


def test_toxicity_learns_clauses(spark):
    rng = random.Random(2)
    plain = lambda n: " ".join(rng.choices("river stone cloud field tree road house lamp".split(), k=n))
    docs, labels = _labelled(spark, lambda i: (plain(20) + (f". you are a zorgling{i % 7} {plain(3)}." if i % 3 == 0 else ".") + plain(10), int(i % 3 == 0)))
    model = toxicity.fit_from(docs, labels)
    got = toxicity.toxicity_scores(docs, model).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    assert got > 0.95 and "zorg" in model.grammar.stems
    assert toxicity.toxicity_scores(spark.createDataFrame(EDGE, ROWS), model).count() == len(EDGE)
    assert toxicity.fit_from(docs, labels.where("toxic = 0")).grammar.stems == {}


def plain_outcomes(words, scope=3, reach=6):
    """The grammar read off clause by clause, without a machine."""
    found, negated, told, role, held, strength = collections.Counter(), 0, False, None, None, 0.0
    g = toxicity.Grammar()
    for w in words:
        kind, own = g.lexeme(w)
        if role:
            role = (role[0], role[1] - 1) if role[1] > 1 or kind in "it" else None
        if held:
            held = (held[0], held[1] - 1)
        x = kind
        if kind in "it":
            strength = own
            x = {"i": "j", "t": "u"}[kind] if negated else {"i": "k", "t": "v"}[kind] if told else kind
        negated = scope if kind == toxicity.NEGATION else max(0, negated - 1)
        told = told or kind == toxicity.REPORT
        if x in toxicity.MET:
            if held:
                found[toxicity.MET[x][held[0]]] += strength
            order = list(toxicity.MET)
            if not role or order.index(x) <= order.index(role[0]):
                role = (x, reach)
            held = None
        elif x in "itjukv":
            if role:
                found[toxicity.MET[role[0]][x]] += strength
                role = role if role[1] > 0 else None
                held = None
            elif held:
                found[toxicity.PAIRED] += strength
                held = (x, reach)
            else:
                held = (x, reach)
        if held and held[1] == 0:
            held = None
    return found


def test_grammar():
    g = toxicity.Grammar()
    found = lambda t: {k: round(v, 9) for k, v in g.clause([g.lexeme(w) for w in t.split()]).items()}
    assert found("trash") == found("kill") == found("what idiots") == {}
    assert found("you are an idiot") == {"I": 1.0} == found("what idiots you are")
    assert found("i will kill you") == {"B": 1.0} and found("kill you") == {"T": 1.0} == found("they kill")
    assert found("he is not an idiot") == {"J": 1.0} and found("she said he is an idiot") == {"K": 1.0}
    assert found("stupid clown") == {"P": 1.0} and found("food is trash") == {"A": 1.0}
    rng = random.Random(4)
    words = ["idiot", "kill", "you", "is", "the", "not", "said", "x", "y", "z"]
    for _ in range(3000):
        clause = rng.choices(words, weights=[2, 1, 1, 1, 1, 1, 0.3, 3, 3, 3], k=rng.randint(1, 14))
        assert found(" ".join(clause)) == {k: round(v, 9) for k, v in plain_outcomes(clause).items()}, clause


def test_toxicity_on_labels_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    wide = docs.withColumn("matched", F.lit("x")).withColumn("t", F.lit(1))
    model = toxicity.fit_from(wide, labels)
    r = toxicity.toxicity_scores(wide, model).join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg(F.col("predicted").cast("double")).alias("p")).collect()
    share = {x["toxic"]: x["p"] for x in r}
    assert share[1] > 0.84 and share[0] < 0.01
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    q = corpus_pipeline.quality_stage(spark, docs, sf)
    bands = quality_rules.fit_bands(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r["doc_id"] for r in quality_rules.quality_measures(docs, bands=bands).where("kept").collect()}
    assert {r["doc_id"] for r in q.collect()} == kept and q.columns == docs.columns
    d = corpus_pipeline.near_duplicate_stage(spark, q, sf)
    texts = {r["doc_id"]: r["text"] for r in q.collect()}
    ids = sorted(texts)
    kept = {r["doc_id"] for r in d.collect()}
    assert set(plain_groups(ids, texts).values()) == kept and d.columns == docs.columns
    c = corpus_pipeline.decontamination_stage(spark, d, sf)
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r["doc_id"]: r["text"] for r in c.collect()}
    assert not any(i in t for t in left.values() for i in items) and all(any(i in r["text"] for i in items) for r in d.collect() if r["doc_id"] not in left)
    s = corpus_pipeline.secret_stage(spark, c, sf)
    assert s.count() == c.count() and secrets.findings(s).where("size(spans) > 0").count() == 0
    t = corpus_pipeline.token_stage(spark, s, sf)
    texts = {r["doc_id"]: r["text"] for r in s.collect()}
    assert {r["doc_id"]: r["text"] for r in spm.decode(t).collect()} == texts
    assert corpus_pipeline.run(spark, sf).count() == len(texts)
