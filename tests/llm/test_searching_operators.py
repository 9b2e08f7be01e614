"""Operators 1, 2, 3, 6, 8 and 10 and the pipeline against brute force, on whole small tables and on every defined case."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import jaccard_join, kneser_ney, mixing, near_vectors, nearest, queries, secrets, substring_dedup, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grouped(nodes, links):
    """The smallest node that each node reaches."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, n):
    w = SPLIT.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_jaccard(rows, n, least):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and min(len(x), len(y)) * 100 >= least * max(len(x), len(y)) and 100 * (both := len(x & y)) >= least * (len(x) + len(y) - both)]
    root = grouped([i for i, _ in sets], links)
    return sorted((i, len(x), root[i]) for i, x in sets)


def brute_windows(rows, size=13):
    words = [(i, SPLIT.findall(t or "")) for i, t in rows if i is not None]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("n,least", [(4, 85), (5, 80)])
def test_jaccard(spark, odd_docs, n, least):
    for docs in (documents(spark), odd_docs) if n == 4 else (odd_docs,):
        got = jaccard_join.join(docs, n=n, least=least).select("doc_id", "n_shingles", "component_id")
        assert sorted(map(tuple, got.collect())) == brute_jaccard(pairs(docs), n, least)


def test_jaccard_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i % 40] + [f"x{i}"] + base[i % 40 + 1 :])) for i in range(150)] + [(1000 + i, " ".join(base)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.join(docs, n=4, least=85).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == brute_jaccard(rows, 4, 85)
    kept = jaccard_join.representatives(docs, jaccard_join.join(docs, n=4, least=85))
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute_jaccard(rows, 4, 85)}


@pytest.mark.parametrize("alone", [False, True])
def test_jaccard_passages_put_in_and_taken_out(spark, monkeypatch, alone):
    if alone:  # no pivots, and every list a long one: across() has to find all
        for name, value in (("PIVOTS", 0), ("TURNS", 1), ("LONG_LIST", 0), ("AT_ONCE", 3), ("APART", 1)):
            monkeypatch.setattr(jaccard_join, name, value)
    rows = []
    for size in (30, 50, 80, 103, 150, 260):
        for more in (1, 2, 4, 7, 12, 20):
            for place in (0, size // 3, size):
                k = len(rows)
                base = [f"w{k}x{i}" for i in range(size)]
                rows += [(k, " ".join(base)), (k + 1, " ".join(base[:place] + [f"n{k}x{i}" for i in range(more)] + base[place:])), (k + 2, " ".join(base[: place // 2] + base[place // 2 + more :]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.join(docs, n=4, least=85).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == brute_jaccard(rows, 4, 85)


def test_windows(spark, odd_docs):
    for docs in (documents(spark), odd_docs):
        got = substring_dedup.dedup(docs, size=13).select("doc_id", "n_words", "n_removed", "kept_sha256")
        assert sorted(map(tuple, got.collect())) == brute_windows(pairs(docs))


ODD_VECTORS = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [float("inf"), 1.0, 0.0]), (7, [1.0, 0.1, 0.0]), (8, [-1.0, 0.0, 0.0]), (100, [1.0, 0.0, 0.0]), (200, [0.0, 1.0, 1.0])]


def vectors(spark):
    return [spark.read.parquet(f"{SF}/embeddings.parquet"), spark.createDataFrame([(i, v, 1, "x") for i, v in ODD_VECTORS], "vec_id long, embedding array<float>, label int, id string")]


def sound(df):
    rows = {r.vec_id: r.embedding for r in df.collect()}
    good = {i: np.array(v, float) for i, v in rows.items() if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    return rows, good


def test_near_vectors(spark):
    for df in vectors(spark):
        rows, good = sound(df)
        ids = sorted(good)
        x = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
        a, b = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
        links = [(ids[i], ids[j]) for i, j in zip(a, b, strict=True)]
        n, root = Counter(i for p in links for i in p), grouped(rows, links)
        got = near_vectors.near_duplicates(df, threshold=0.95).select("vec_id", "n_links", "component_id", "kept")
        assert sorted(map(tuple, got.collect())) == sorted((i, n[i], root[i], root[i] == i) for i in rows)


def test_near_vectors_shuffles_a_tile_once_a_panel(spark, monkeypatch):
    """Many tiles in few panels: every pair of tiles meets in one cell, and no tile is copied more often than there are panels."""
    monkeypatch.setattr(near_vectors, "TILE", 16)
    monkeypatch.setattr(near_vectors, "PANELS", 4)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 12))
    x[300:400] = x[:100] + rng.normal(size=(100, 12)) * 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen = []
    cells = near_vectors.in_cells
    monkeypatch.setattr(near_vectors, "in_cells", lambda *a: seen.append((a[1], cells(*a))) or seen[0][1])
    got = sorted(tuple(r) for r in near_vectors.near_duplicates(df).select("vec_id", "n_links", "component_id").collect())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    links = list(zip(a.tolist(), b.tolist(), strict=True))
    n, root = Counter(i for p in links for i in p), grouped(dict(enumerate(x)), links)
    assert links and got == sorted((i, n[i], root[i]) for i in range(700))
    ((panels, met),) = seen
    copies = Counter(r.tile for r in met.select("tile").collect())
    assert panels == 4 and len(copies) > 40 and max(copies.values()) <= panels


def test_nearest_recall(spark):
    for df in vectors(spark):
        _, good = sound(df)
        ids = np.array(sorted(good))
        x = np.stack([good[i] for i in ids])
        found, hits, wanted = defaultdict(list), 0, 0
        for r in nearest.Index(df).search(F.col("id") % 100 == 0, k=10).collect():
            assert r.score == pytest.approx(math.dist(good[r.query_id], good[r.vec_id]), rel=1e-12, abs=1e-12)
            found[r.query_id].append((r.rank, r.score, r.vec_id))
        for q in ids[ids % 100 == 0]:
            far = np.sqrt(((x - good[q]) ** 2).sum(1))
            best = sorted((d, i) for d, i in zip(far, ids, strict=True) if i != q)[:10]
            mine = sorted(found[q])
            assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
            assert [(d, i) for _, d, i in mine] == sorted((d, i) for _, d, i in mine)
            hits += len({i for _, _, i in mine} & {i for _, i in best})
            wanted += len(best)
        assert hits >= 0.9 * wanted


def test_toxicity_risk_and_gradient(spark):
    """The sums over tasks against the written-out risk of Counters, and the gradient against differences."""
    bad, good = "awful nasty gunk here", "a calm and plain text about rivers"
    docs = spark.createDataFrame([(i, f"{bad} {'nasty ' * (i % 3)}w{i}" if i % 4 == 0 else f"{good} w{i % 7}" if i % 9 else None) for i in range(400)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400, 2)], "doc_id long, toxic int")
    docs = docs.where(toxicity.fold("doc_id") != 1)
    p_docs, prior = toxicity.confirmed(docs, labels)
    n_p, n_u = p_docs.count(), docs.count()
    best = toxicity.selected(p_docs, docs, n_p, n_u)
    assert len(best) and prior > 0
    some = toxicity.rows_of(p_docs, best).collect()
    p = toxicity.Part.of(np.array([r["n"] for r in some]), [bytes(r["h"]) for r in some], np.array([r["times"] for r in some]))
    rows = toxicity.rows_of(docs, best)
    w = np.random.default_rng(3).normal(0, 0.5, len(best) + 2)

    def risk(w):
        model = toxicity.Model(best, w[:-1], float(w[-1]), prior)
        at = {n: np.array([r["score"] for r in toxicity.score(d, model).collect()]) for n, d in (("p", p_docs), ("u", docs))}
        negative = -np.log(1 - at["u"]).mean() + prior * np.log(1 - at["p"]).mean()
        return -prior * np.log(at["p"]).mean() + max(0.0, negative), negative

    for w[-1] in (-3.0, 2.0):
        loss, negative, grad = toxicity.descent(p, n_p, n_u, prior, w, toxicity.over_u(rows, w))
        assert np.allclose((loss, negative), risk(w), atol=1e-6)
        part = 1 if negative < 0 else 0
        for k in (0, len(best) - 1, len(w) - 2, len(w) - 1):
            step = np.eye(len(w))[k] * 1e-4
            slope = (risk(w + step)[part] - risk(w - step)[part]) / 2e-4
            assert np.isclose(grad[k], -slope if part else slope, atol=1e-4)


def test_toxicity_of_empty_tables(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, labels)).collect()} == {0.0}
    none = odd_docs.limit(0)
    assert toxicity.score(none, toxicity.fit(none, spark.createDataFrame([(1, 1)], labels.schema))).count() == 0


def test_toxicity_held_out(spark, odd_docs):
    sf = f"{os.path.dirname(SF)}/sf0.1"  # the smaller tables hold too few confirmed examples to learn from
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([(a > b) + (a == b) / 2 for a in bad for b in good])
    caught, wrong = np.mean(np.array(bad) >= 0.7), np.mean(np.array(good) >= 0.7)
    print(f"held out: {len(bad)} toxic, {len(good)} clean; AUC {auc:.4f}, caught {caught:.4f}, wrongly {wrong:.4f}")
    assert auc > 0.9 and wrong < 0.1 and caught > 0.8
    again = toxicity.score(odd_docs, toxicity.fit(docs, labels))
    assert again.count() == odd_docs.count()


def test_quality_separates_labels(spark, odd_docs):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    judged = kneser_ney.judge(docs, labels.where("quality = 1"))
    rows = {r.doc_id: r for r in judged.collect()}
    assert len(rows) == docs.count()
    good = [rows[r.doc_id].kept for r in labels.where("quality = 1").collect() if r.doc_id in rows]
    assert np.mean(good) > 0.97
    wide = f"{os.path.dirname(SF)}/sf0.01"  # enough documents labelled bad to state a share
    labels_ = spark.read.parquet(f"{wide}/labels.parquet")
    kept = {r.doc_id: r.kept for r in kneser_ney.judge(spark.read.parquet(f"{wide}/documents.parquet"), labels_.where("quality = 1")).collect()}
    bad = [kept[r.doc_id] for r in labels_.where("quality = 0").collect() if r.doc_id in kept]
    assert len(bad) > 40 and np.mean(bad) < 0.15  # what is not rejected of them
    none = kneser_ney.judge(odd_docs, labels.where("quality > 5"))
    assert {r.doc_id for r in none.collect() if not r.kept and r.doc_id is not None} == {r.doc_id for r in odd_docs.collect() if r.doc_id is not None and not SPLIT.search(r.text or "")}


def brute_kneser_ney(taught, texts):
    """Log probabilities by a plain bigram model with every word of the taught texts."""
    pairs_of = lambda t: list(zip([None, *(w := SPLIT.findall(t or ""))], [*w, None], strict=True)) if SPLIT.search(t or "") else []
    count = Counter(p for t in taught for p in pairs_of(t))
    total, kinds, before = Counter(), defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (a, b), c in count.items():
        total[a] += c
        kinds[a][min(c, 3)] += 1
        before[b] += 1
    number = lambda counts: [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
    d2, d1 = kneser_ney.discounts(*number(count)), kneser_ney.discounts(*number(before))
    unseen = sum(d1[min(c, 3)] for c in before.values()) / len(count) / (len(before) + 1)
    lower = lambda b: max(before[b] - d1[min(before[b], 3)], 0) / len(count) + unseen
    assert sum(lower(b) for b in before) + lower("not there") == pytest.approx(1)

    def p(a, b):
        if a not in total:
            return lower(b)
        c = count.get((a, b), 0)
        return (c - d2[min(c, 3)]) / total[a] + sum(d2[k] * kinds[a][k] for k in (1, 2, 3)) / total[a] * lower(b)

    return [sum(math.log(p(a, b)) for a, b in pairs_of(t)) for t in texts]


def test_quality_has_every_trusted_word(spark):
    """200,000 different words in trusted texts, in a small language only the rarest, against a plain model."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{k}" for k in [*range(5000 * i, 5000 * i + 5000), *rng.integers(0, 200, 300), *range(5000 * i, 5000 * i + 60 * i)]), "en") for i in range(40)]
    rows += [(100 + i, " ".join(f"r{k}" for k in rng.integers(0, 400, 50)), "xx") for i in range(20)]
    rows += [(200, "w199999 w199998 nowhere w7 w8 w9", "en"), (201, "no word of it", None), (202, "r1 r2 r3", "xx"), (203, None, "en"), (204, " ", "xx"), (205, "w3", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = docs.where("doc_id < 200").select("doc_id")
    taught = {r.id for r in kneser_ney.marked(docs, trusted, "doc_id", "text", "lang").where("role = 1").collect()}
    got = {r.doc_id: r.log_p for r in kneser_ney.judge(docs, trusted).collect()}
    want = brute_kneser_ney([t for i, t, _ in rows if i in taught], [t for _, t, _ in rows])
    for (i, _, _), x in zip(rows, want, strict=True):
        assert got[i] == pytest.approx(x, rel=1e-5, abs=1e-5)
    assert len({w for i, t, _ in rows if i in taught for w in t.split()}) > 1 << 17, "so few that a cut would not show"


def test_empty_tables(spark, odd_docs):
    none = odd_docs.where("false")
    assert jaccard_join.join(none).count() == 0
    assert substring_dedup.dedup(none).count() == 0
    assert kneser_ney.judge(none, none.select("doc_id")).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors.near_duplicates(empty).count() == 0
    assert nearest.Index(empty).search(F.col("id") % 100 == 0, k=10).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = documents(spark)
    columns = docs.columns
    good = c.quality(spark, docs, SF)
    judged = {r.doc_id: r.kept for r in kneser_ney.judge(docs, spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, k in judged.items() if k}
    single = c.near_copies(spark, good, SF)
    assert sorted(r.doc_id for r in single.collect()) == sorted({x for _, _, x in brute_jaccard(pairs(good), 5, 80)})
    clean = c.hide_secrets(spark, single, SF)
    before, after = dict(pairs(single)), dict(pairs(clean))
    spans = {r.doc_id: r.spans for r in secrets.findings(single).collect()}
    for i, text in before.items():
        for s in spans[i]:
            assert text[s.start : s.end] not in after[i] or s.end - s.start < 12
        assert spans[i] or after[i] == text
    drawn = c.mixture(spark, clean, SF)
    times = Counter(r.doc_id for r in drawn.collect())
    mixed = {r.doc_id: r for r in mixing.mix(clean).collect()}
    assert times == Counter({i: r.taken // r.size for i, r in mixed.items() if r.taken})
    for df in (good, single, clean, drawn):
        assert df.columns == columns
    ids = c.token_ids(spark, drawn, SF)
    assert Counter(r.doc_id for r in ids.select("doc_id").collect()) == times


def test_every_query_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for size in (1, 20, 300, 4_000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for more in (0, 1, 7, size):
            b = np.unique(np.concatenate([a[more // 2 :], rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
            x, y = (p.view(np.uint64) for p in jaccard_join.parities([a, b]))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_matching_statistics():
    rng = np.random.default_rng(1)
    seen = set()
    for _ in range(40):
        held = [rng.integers(0, 4, rng.integers(3, 12)).astype(np.uint64) for _ in range(5)]
        index = substring_dedup.FMIndex(np.concatenate(held), np.array([len(x) for x in held]), np.arange(5), 4)
        asked = [rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64) for _ in range(4)]
        stat, lo, hi = index.statistics(np.concatenate(asked), np.array([len(x) for x in asked]))
        holds = lambda w: {k for k, x in enumerate(held) if any((x[j : j + len(w)] == w).all() for j in range(len(x) - len(w) + 1))}  # noqa: B023, E731
        at = 0
        for x in asked:
            for j in range(len(x)):
                m = max(k for k in range(min(4, len(x) - j) + 1) if not k or holds(x[j : j + k]))
                assert stat[at] == m and (not m or set(index.owner[lo[at] : hi[at]].tolist()) == holds(x[j : j + m]))
                seen.add(m)
                at += 1
    assert seen == {0, 1, 2, 3, 4}


def test_windows_shared_by_later_documents_only(spark):
    """Documents around one minimizer: the earliest lacks windows that later ones share."""
    rng = np.random.default_rng(3)
    middle = [f"m{i}" for i in range(9)]
    rows = [(i, " ".join([f"l{rng.integers(3)}x{k}" for k in range(6)] + middle + [f"r{rng.integers(3)}x{k}" for k in range(6)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.dedup(docs, size=13).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == brute_windows(rows)
