"""Operators 11, 12 and 13 against brute force, on whole small tables and on every defined case."""

import hashlib
import math
import os
import re

import numpy as np
import pytest
from gleaner.llm import codes, hard_negatives, integers, licenses, queries
from pyspark.sql import functions as F

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KIND = "vec_id long, embedding array<float>, label int, id string, q string, uid int, v int, dim long"


def vectors():
    """Nulls, odd numbers, copies, ties, zero, short, long and huge vectors, null ids and labels, repeated ids."""
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.2, (90, 64)).astype(np.float32)
    rows = [(7 * i, base[i].tolist(), i % 4) for i in range(90)]
    rows += [(1000 + i, base[3].tolist(), i % 3) for i in range(150)]  # copies, some of them anchors
    rows += [(2000, None, 1), (2050, [float("nan")] * 64, 1), (2100, [None] * 64, 1), (2150, [float("inf")] + [0.0] * 63, 2), (2200, [0.0] * 64, 2)]
    rows += [(None, base[1].tolist(), 1), (2250, base[2].tolist(), None), (2300, base[2, :40].tolist(), 2), (2350, base[4, :40].tolist(), 2), (2351, base[5, :40].tolist(), 3)]
    rows += [(2400, [], 1), (2450, [], 1), (2451, [], 2), (2500, base[7].tolist(), 1), (2500, base[8].tolist(), 1), (2500, base[7].tolist(), 1)]
    rows += [(2550, [3e30] + [-3e30] * 63, 1), (2551, [3e30] + [-3e30] * 63, 2)]
    return [(*r, "x", "y", 1, 2, 3) for r in rows]


def ints(v):
    most = integers.most(len(v))
    return np.clip(np.floor(256 * np.array(v, np.float64)), -most, most).astype(np.int64) if len(v) else np.zeros(0, np.int64)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows):
    rows = [(i, ints(v), lab) for i, v, lab, *_ in rows if i is not None and lab is not None and good(v)]
    rows = [(i, q, (lab + 1) % 10 if i % 7 == 0 else lab) for i, q, lab in rows]
    out = []
    for a, qa, la in rows:
        if a % 50:
            continue
        scored = sorted(((-int(qa @ q), i, lab) for i, q, lab in rows if len(q) == len(qa)), key=lambda x: x[:2])
        for p, pos, _ in [x for x in scored if x[2] == la and x[1] != a][:5]:
            inside = [x for x in scored if x[2] != la and 50 * -p <= 100 * -x[0] <= 95 * -p][:3]
            out += [(a, pos, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(inside)]
    return sorted(out)


def brute_codes(rows):
    rows = [(i, ints(v), lab) for i, v, lab, *_ in rows if good(v)]
    width = -(-max(len(q) for _, q, _ in rows) // 16)
    wide = [(i, np.concatenate([q, np.zeros(16 * width - len(q), np.int64)]).reshape(16, width), lab, q.astype("<i4").tobytes()) for i, q, lab in rows]
    first = sorted(wide, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:64]
    books = np.stack([r[1] for r in first], 1)
    x = np.stack([r[1] for r in wide])

    def assign():
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        return far.argmin(2), far.min(2).sum(1)

    for _ in range(2):
        code, _ = assign()
        for p in range(16):
            for e in range(books.shape[1]):
                if len(mine := x[code[:, p] == e, p]):
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    code, error = assign()
    name = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = {}
    for r, e in zip(wide, error, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + int(e)
    return sorted(((r[0], bytes(c.tolist()).hex(), int(e), sums[r[2]], name) for r, c, e in zip(wide, code, error, strict=True)), key=repr)


def test_negatives_of_odd_vectors(spark, monkeypatch):
    df = spark.createDataFrame(vectors(), KIND)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    want = brute_negatives(vectors())
    got = lambda: sorted(tuple(r) for r in hard_negatives.mine(df, F.col("id") % 50 == 0, label=label).collect())
    assert len(want) > 20 and got() == want
    for name, value in (("ROWS", 16), ("ANCHORS", 4), ("CHUNK", 10), ("PANEL", 1)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert got() == want
    assert hard_negatives.mine(df.where("false"), F.col("id") % 50 == 0).collect() == []


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for top in (100, (1 << 24) - 1, 1 << 30):
        a, b = rng.integers(-top, top, (5, 32)).astype(np.int32), rng.integers(-top, top, (7, 32)).astype(np.int32)
        want = [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b] for r in a]
        if max(abs(v) for r in want for v in r) < 1 << 62:
            assert hard_negatives.product(a, b).tolist() == want


def test_codes_of_odd_vectors(spark, monkeypatch):
    df = spark.createDataFrame(vectors(), KIND)
    got = lambda: sorted((tuple(r) for r in codes.compress(df).collect()), key=repr)
    want = brute_codes(vectors())
    assert got() == want
    monkeypatch.setattr(codes, "MOST_LABELS", 1)
    assert got() == want
    assert codes.compress(df.where("false")).collect() == []
    few = [r for r in vectors() if r[0] in (7, 14)]
    assert sorted((tuple(r) for r in codes.compress(spark.createDataFrame(few, KIND)).collect()), key=repr) == brute_codes(few)


def test_exponion_equals_every_comparison():
    rng = np.random.default_rng(3)
    for spread in (2, 9, 4000):  # narrow ones tie often
        book, x = rng.integers(-spread, spread, (64, 4)), rng.integers(-spread, spread, (3000, 4))
        far = ((x[:, None] - book) ** 2).sum(2)
        for start in (np.zeros(3000, np.int64), rng.integers(0, 64, 3000)):
            code, least = codes.nearest(x, book, codes.neighbours(book), start)
            assert (code == far.argmin(1)).all() and (least == far.min(1)).all()


LINES = [
    "Released under the MIT License.",
    "x\nLicensed under the Apache License, Version 2.0. CC BY-NC, and cc by\tnc 4.0; under-the.MIT/license",
    "This program is free software: you may redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "Permission is hereby granted, free of charge at all, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in our Software without restriction",
    "Permission is hereby granted, free of charge, and then nothing of the kind follows at all",
    "UNDER THE mit LICENSE under the mit license " * 300,
    "die lizenz: under the mit lizenz; cc by. nc",
    "naïve cc by nc — 中文 cc by nc",
]


def brute_base(text):
    w = re.findall(licenses.WORD, (text or "").translate(str.maketrans(licenses.UPPER, licenses.UPPER.lower())))
    hits = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        hits += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    places = [i for i, _ in hits]
    return len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses(spark, odd_docs):
    rows = [(200 + i, t) for i, t in enumerate(LINES)] + [(200, LINES[0]), (200, LINES[1]), (None, LINES[2]), (201, None)] * 2
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("id", F.lit(1)).withColumn("w", F.lit("z")).withColumn("label", F.lit(2))
    got = sorted((tuple(r) for r in licenses.report(licenses.spans(docs)).collect()), key=repr)
    want = sorted(((r.doc_id, *brute_base(r.text)) for r in docs.collect()), key=repr)
    assert sorted((r[:6] for r in got), key=repr) == want
    assert all(0 <= r[7] <= 1 and set(filter(None, r[5].split(","))) <= set(filter(None, r[6].split(","))) for r in got)
    of = {r[0]: r for r in got if r[0] and r[0] > 201}
    assert of[202][6] == "gpl" and of[203][6] == "mit" and of[204][6] == "" and 0 < of[204][7] < 0.6  # changed notices, and a beginning alone
    assert licenses.spans(docs.where("false")).collect() == []
    with pytest.raises(ValueError, match="needs 3 words"):
        licenses.spans(docs, [licenses.Template("x", "two words")])


def test_many_templates_join_by_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string")
    want = sorted(map(tuple, licenses.report(licenses.spans(docs)).collect()))
    monkeypatch.setattr(licenses, "MOST_GRAMS", 1)
    assert sorted(map(tuple, licenses.report(licenses.spans(docs)).collect())) == want


def test_no_python_in_the_license_plan(spark):
    plan = queries.op13_licenses(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_whole_tables(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op11_hard_negatives(spark, SF).collect())) == brute_negatives(rows)
    assert sorted((tuple(r) for r in queries.op12_vector_codes(spark, SF).collect()), key=repr) == brute_codes(rows)


def test_each_length_of_vectors_is_compared(spark):
    """Operators 3 and 10: equal vectors link whatever the other rows' length; the threshold is decided on the vectors as given."""
    from gleaner.llm import near_vectors, nearest

    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0, 1.0]), (4, [0.0, 1.0, 1.0]), (5, [0.0, 0.0]), (6, None), (100, [0.0, 1.0, 0.5]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in near_vectors.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (100, 0, 100, True)]
    found = [(r.query_id, r.vec_id) for r in nearest.Index(df).search(F.col("id") % 100 == 0).orderBy("rank").collect()]
    assert found == [(100, 3), (100, 4)]
    x = np.array([[3.0, 4.0], [4.0, 3.0]])
    edge = float(near_vectors.cosines(x[:1], x[1:])[0])
    unit = near_vectors._unit(x)
    turn = near_vectors.directions(np.random.default_rng(1).normal(size=(50, 2)))
    assert near_vectors.links(unit[:1] @ turn, unit[1:] @ turn, edge, (x[:1], x[1:])).all()
    assert not near_vectors.links(unit[:1] @ turn, unit[1:] @ turn, np.nextafter(edge, 2), (x[:1], x[1:])).any()
