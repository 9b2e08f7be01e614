"""Operators 4, 5, 7 and 9 against brute force."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from gleaner.llm import byte_bpe, mixing, secrets, token_store
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_bpe_equals_tiktoken(spark, odd_docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in odd_docs.collect():
        ids = t.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(rows_of(byte_bpe.encode(odd_docs, path, P.PATTERN, digest=True)), key=str) == sorted(want, key=str)
    ids = byte_bpe.encode(odd_docs, path, P.PATTERN)
    back = rows_of(byte_bpe.decode(ids, path, P.PATTERN))
    assert sorted((i, bytes(b).decode()) for i, b in back if i is not None) == sorted((r.doc_id, r.text or "") for r in odd_docs.collect() if r.doc_id is not None)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcehilnorst \n'é漢1"), max_size=60))
def test_long_words_contract_alike(text):
    import tiktoken

    c = byte_bpe.Coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    for x in (text, text * 40, "a" * 700 + text.replace(" ", "") + "ab" * 300):
        ids, starts, raw, cuts = c.encode([x, text])
        assert ids[: starts[1]].tolist() == t.encode_ordinary(x) and ids[starts[1] :].tolist() == t.encode_ordinary(text)
        assert c.decode(ids, starts) == [x.encode(), text.encode()] == [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def test_recursion_goes_on_from_where_it_was_cut(monkeypatch):
    import tiktoken

    c = byte_bpe.Coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    for rows, words, kept in ((1, 3, 5), (200, 1, 1)):
        for name, value in (("MOST_ROWS", rows), ("WORDS_AT_ONCE", words), ("CACHE_WORDS", kept), ("IDS_AT_ONCE", 2)):
            monkeypatch.setattr(byte_bpe, name, value)
        for x in ("unhappily misunderstood xylophonists", "ababababab zzzzzzzzz", "Donaudampfschifffahrt 1234567 it's"):
            ids, starts, _, _ = c.encode([x])
            assert ids.tolist() == t.encode_ordinary(x) and c.decode(ids, starts) == [x.encode()]


def test_store_round_trip(spark, odd_docs, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    token_store.write(odd_docs, str(tmp_path / "s"), path)
    docs = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want, at = [], 0
    for r in docs:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = sorted(rows_of(token_store.digests(spark, str(tmp_path / "s"))), key=lambda r: r[1])
    assert got == [w[:4] for w in want]
    full = sorted(rows_of(token_store.read(spark, str(tmp_path / "s"))), key=lambda r: r[1])
    assert [(a, b, list(c)) for a, b, c in full] == [(w[0], w[1], w[4]) for w in want]
    packs = spark.read.parquet(str(tmp_path / "s/packs")).where("payload is not null")
    assert packs.count() == packs.select("chunk").distinct().count()
    spark.read.parquet(str(tmp_path / "s/recipes")).where("doc_id is null or doc_id <> 3").write.parquet(str(tmp_path / "r2"))
    spark.read.parquet(str(tmp_path / "r2")).write.mode("overwrite").parquet(str(tmp_path / "s/recipes"))
    with pytest.raises(ValueError, match="manifest"):
        token_store.digests(spark, str(tmp_path / "s"))


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 49_000, 40_000).astype(np.uint32), rng.integers(0, 49_000, 777).astype(np.uint32)
    parts = lambda x: {x[i:j].tobytes() for _, _, i, j in token_store.cut(x, np.array([0, len(x)]))}
    same = parts(a) & parts(np.concatenate([b, a]))
    assert len(same) > 0.7 * len(parts(a))
    assert b"".join(a[i:j].tobytes() for _, _, i, j in token_store.cut(a, np.array([0, len(a)]))) == a.tobytes()
    two = np.concatenate([a, a])  # a document is cut alike after another one
    assert {two[i:j].tobytes() for _, _, i, j in token_store.cut(two, np.array([0, len(a), len(two)]))} == parts(a)


def test_crc_join():
    pairs = [(b"", b""), (b"a", b""), (b"", b"bc"), (b"hello ", b"world" * 999)]
    got = token_store.crc_join(*[np.array(x) for x in zip(*[(zlib.crc32(a), zlib.crc32(b), len(b)) for a, b in pairs], strict=True)])
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def brute_spans(text):
    out = []
    key = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), m.end(), 0, "assign") for m in key.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1, "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2, "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_secrets(spark, odd_docs):
    found = secrets.findings(odd_docs)
    got = rows_of(secrets.report(found))
    want = []
    for r in odd_docs.collect():
        s = brute_spans(r.text or "")
        text = ",".join(f"{k}:{a}:{b}" for a, b, _, k in s)
        want.append((r.doc_id, *[sum(x[3] == k for x in s) for k in ("assign", "access", "hex")], hashlib.sha256(text.encode()).hexdigest(), text))
    assert sorted(got, key=str) == sorted(want, key=str)
    clean = secrets.redact(odd_docs, found)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    assert not any("hunter2" in (r.text or "") for r in clean.collect())


def test_ledger_scans_unseen_pairs_only(spark, odd_docs):
    ledger = secrets.scan(secrets.blobs(odd_docs.limit(8)))
    again = secrets.scan(secrets.blobs(odd_docs), ledger=ledger)
    assert again.join(ledger, ["blob", "kind", "version"], "left_semi").count() == 0
    assert rows_of(secrets.findings(odd_docs, ledger=ledger).orderBy("doc_id", "blob")) == rows_of(secrets.findings(odd_docs).orderBy("doc_id", "blob"))
    newer = (secrets.RULES[0], secrets.Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20, 2), secrets.RULES[2])
    full = secrets.scan(secrets.blobs(odd_docs))
    assert {r.kind for r in secrets.scan(secrets.blobs(odd_docs), newer, full).collect()} == {"access"}


def test_mixing(spark, odd_docs):
    rows = mixing.mix(odd_docs).collect()
    docs = odd_docs.collect()
    assert len(rows) == len(docs)
    size = lambda t: len(SPLIT.findall(t or ""))
    sums = {}
    for r in docs:
        sums[r.source] = sums.get(r.source, 0) + size(r.text)
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sums[s] for s in names], [i % 3 + 1 for i in range(len(names))])
    assert abs(sum(want) - sum(sums.values())) < 1e-6 and all(w <= 3 * sums[s] + 1e-9 for w, s in zip(want, names, strict=True))
    by_id = {r.doc_id: r for r in docs}
    for r in rows:
        d = by_id[r.doc_id]
        assert r["size"] == size(d.text) and r.source_size == sums[d.source] and 0 <= r.taken <= 3 * r["size"]
        assert abs(r.target - want[names.index(d.source)]) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd_docs.repartition(3)).collect()))


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 900), f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    got["source"] = got.doc_id.map({r[0]: r[2] for r in rows})
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) < 0.01 * g.target.iloc[0]


def test_overlapping_sources_share_words(spark):
    flow = mixing.route({(0,): 100, (0, 1): 100, (1,): 10}, [100, 110])
    assert sum(flow.values()) == 210 and flow[(0, 1)] == 100 and flow[(1,)] == 10  # nothing repeats while words are left
    rows = [(i, "w " * 10, [["a"], ["a", "b"], ["b"], None][i % 4]) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"))
    assert got.count() == 400 and got.where("taken > 3 * size").count() == 0


def test_empty_tables(spark, odd_docs, tmp_path):
    none = odd_docs.limit(0)
    assert mixing.mix(none).count() == 0
    assert secrets.report(secrets.findings(none)).count() == 0
    assert byte_bpe.encode(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, digest=True).count() == 0
    token_store.write(none, str(tmp_path / "e"), P.path("word_bpe_49k.json"))
    assert token_store.digests(spark, str(tmp_path / "e")).count() == 0


def test_pipeline_ids_are_held_against_the_text(spark, odd_docs, monkeypatch):
    import corpus_pipeline

    whole = corpus_pipeline.token_ids(spark, odd_docs, "").collect()
    assert len(whole) == odd_docs.count() and all(len(r.ids) == r.n_tokens for r in whole)
    monkeypatch.setattr(P, "PATTERN", "[a-z]+")  # finds no spaces, so the ids lack them
    with pytest.raises(Exception, match="do not decode to its text"):
        corpus_pipeline.token_ids(spark, odd_docs, "").collect()


def test_ledger_scans_unseen_blobs_only(spark, odd_docs, tmp_path):
    path = str(tmp_path / "ledger")
    ledger = secrets.record(odd_docs, path)
    seen = ledger.count()
    assert seen == 3 * secrets.blobs(odd_docs).count()
    want = sorted(map(str, secrets.findings(odd_docs).collect()))
    assert sorted(map(str, secrets.recorded(odd_docs, ledger).collect())) == want
    assert secrets.record(odd_docs, path).count() == seen
    later = odd_docs.unionByName(odd_docs.limit(1).withColumn("text", F.lit("now token = abcdefgh")))
    assert secrets.record(later, path).count() == seen + 3
    rules = (secrets.Rule("hex", "[0-9a-f]{30,}", 0, 30, version=2),)
    assert secrets.record(later, path, rules).count() == seen + 3 + (seen + 3) // 3
    assert sum(len(r.spans) for r in secrets.recorded(later, secrets.opened(spark, path), rules).collect()) == 2  # the runs of a and b


def test_clashing_columns(spark):
    from gleaner.llm import jaccard_join

    names = ["_spans", "_t", "_blob", "_times", "_copy", "_size", "_id", "_body", "id", "size", "row", "blob", "spans", "body", "count", "n"]
    docs = spark.createDataFrame([(k, f"a b c d e password = hunter22 {k // 2}", "en", f"s{k % 2}", 9, *["z"] * len(names)) for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    clean = secrets.redact(docs, secrets.findings(docs))
    assert clean.columns == docs.columns and not clean.where("text like '%hunter%' or _t <> 'z'").count() and clean.count() == 6
    assert mixing.drawn(docs, mixing.mix(docs)).columns == docs.columns
    kept = jaccard_join.representatives(docs, jaccard_join.join(docs))
    assert kept.columns == docs.columns and 0 < kept.count() <= 6


def test_equal_rows_are_taken_singly(spark):
    rows = [(1, "w " * 10, f"s{k % 2}") for k in range(8)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in {r.target for r in got}:
        mine = [r for r in got if r.target == source]
        assert abs(sum(r.taken for r in mine) - source) <= 5


def test_draws_are_what_the_mix_takes(spark):
    """Equal rows, and rows of one id in several sources with different texts, are drawn word for word as planned."""
    equal = [(1, "a b c d e f g h i j", "s1")] * 8
    several = [(i, " ".join(f"{s}{i}{k}" for k in range(6 + i)), s) for i in range(3) for s in ("p", "q")]
    many = [(i % 4, "x y z " * (i % 5), f"s{i % 3}") for i in range(200)]
    for rows in (equal, several, many, equal + several + many + [(9, None, "s1"), (None, "n u l l", None)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/draws-{len(rows)}")
        docs = spark.read.parquet(path)
        mixed = mixing.mix(docs)
        words = F.size(F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0)))
        got = {r[0]: r[1] for r in mixing.drawn(docs, mixed).groupBy("source").agg(F.sum(words)).collect()}
        want = {}
        plan = mixed.groupBy("row_key").agg(F.sum("taken").alias("t")).join(docs.select(F.xxhash64("doc_id", "text", "source").alias("row_key"), "source").distinct(), "row_key")
        for r in plan.collect():
            want[r.source] = want.get(r.source, 0) + r.t
        assert got == {k: v for k, v in want.items() if v}
        assert sum(got.values()) == mixed.agg(F.sum("taken")).first()[0]


def test_routes_are_the_cheapest(spark):
    """The flow against every distribution of words: as many as the quotas allow, at the least repetition."""
    rng = np.random.default_rng(4)
    cost = lambda taken, words: sum(r * min(max(taken - r * words, 0), words) for r in range(3))
    for _ in range(25):
        words = {(0,): int(rng.integers(0, 4)), (1,): int(rng.integers(0, 4)), (0, 1): int(rng.integers(0, 4))}
        quotas = [int(q) for q in rng.integers(0, 12, 2)]
        best = None
        for a in range(3 * words[0,] + 1):
            for b in range(3 * words[1,] + 1):
                for c in range(3 * words[0, 1] + 1):
                    for left in range(c + 1):
                        if a + left <= quotas[0] and b + c - left <= quotas[1]:
                            told = (-(a + b + c), cost(a, words[0,]) + cost(b, words[1,]) + cost(c, words[0, 1]))
                            best = told if best is None else min(best, told)
        got = mixing.route(words, quotas)
        assert (-sum(got.values()), sum(cost(got[k], words[k]) for k in words)) == best


def test_targets_by_their_rules():
    """Shares by weight, none above three times its size, all words given out unless every source is full."""
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 9):
        for _ in range(20):
            sizes, weights = [int(x) for x in rng.integers(0, 1000, n) * rng.integers(0, 2, n)], [i % 3 + 1 for i in range(n)]
            got = mixing.targets(sizes, weights)
            assert all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes, strict=True))
            free = [(t / w) for t, s, w in zip(got, sizes, weights, strict=True) if s and t < 3 * s - 1e-6]
            assert not free or max(free) - min(free) < 1e-6 * max(free)
            full = [(t / w) for t, s, w in zip(got, sizes, weights, strict=True) if s and t >= 3 * s - 1e-6]
            assert not free or not full or max(full) <= min(free) + 1e-6
            assert abs(sum(got) - sum(sizes)) < 1e-6 * max(1, sum(sizes))
