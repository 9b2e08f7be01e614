"""Quality classifier by an interpolated modified Kneser-Ney bigram model (operator 2).

The model is trained on every trusted text, and every word of theirs is in it.  Words are named by 64-bit hashes.  Counts of
word pairs are kept in shards by the pair's hash, and what is known of a word (its pairs as a context, its different contexts)
in shards by the word's hash; only a few sums over all words are sent around.  A pair that was not counted has the log
probability log back(a) + log p1(b), so a document's is a sum over its words, and counted pairs add a number of their own.
Texts' words and pairs are sent to the shards, and each shard returns the sums of its own for every document.

A word that no trusted text has is the unknown word: it has the probability of a word without contexts, and as a context
leaves all to p1.

Discounts D1, D2, D3+ come from the counts of counts, for pairs and for continuations.  A document is rejected if its
perplexity is above its language's limit, taken from quantiles of trusted documents that were not trained on: the limit is
q50 + STRETCH * (q95 - q50) of log perplexity, so a clean document is not rejected for being in the upper tail of clean ones.

Defined cases: a text without words, or a null one, has no perplexity and is rejected; a null language is a language of its
own; a language without enough held-out trusted documents uses the quantiles over all languages; without trusted texts
nothing is rejected but texts without words; a null id is never trusted; repeated rows give one row each (scored alike);
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import SENT, at_shards, block_names, frame, home, sent, shards, split_rows, text_blocks
from .kernel import chunks, deltas, mix, pack, undeltas, unpack, words
from .shared import discard, free_shuffles, stored

#: Ids that are broadcast; more trusted documents than that are joined by a shuffle.
MOST_IDS = 2_000_000
STRETCH = 2.0
LEAST_HELD_OUT = 30
TRAIN, TRIAL = 1, 2
#: Documents are scored in so many rounds, by runs of 2 ** RUN ids, so that neighbours in a file share a block.
ROUNDS, RUN = 4, 14
#: Bytes of texts in a block: a word takes several numbers there.
ASK_BYTES = 8 << 20
#: What a shard reads, in this order: counts of pairs, what their words' shards know of the words, its own words, what blocks ask, blocks' documents.
PAIRS, REPLY, WORDS, ASK, HEAD, ABOUT = range(6)
#: The word before the first and after the last one.
EDGE = np.uint64(0x6B6E2D656467653F)
_CONTEXT = np.uint64(0xD6E8FEB86659FD93)


def marked(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """id, text, lang (a hash) and role of every row: TRAIN for four fifths of the trusted documents by hash of the id, TRIAL for the others."""
    src = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("text"), F.xxhash64(F.coalesce(docs[lang_col].cast("string"), F.lit("\0"))).alias("lang"))
    ids = trusted.select(trusted[id_col].cast("long").alias("_id")).where("_id is not null").distinct()
    ids = ids.withColumn("role", F.when(F.pmod(F.xxhash64("_id"), F.lit(5)) == 0, TRIAL).otherwise(TRAIN))
    if ids.count() <= MOST_IDS:
        ids = F.broadcast(ids)
    return src.join(ids, "_id", "left").select(F.coalesce("_id", F.lit(NO_ID)).alias("id"), "text", "lang", F.coalesce("role", F.lit(0)).alias("role"))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block, made piece by piece, and where each document's words start."""
    h, sizes = [], []
    for lo, hi in chunks(offsets):
        a, b = words(data, offsets[lo : hi + 1])
        h.append(a)
        sizes.append(np.diff(b))
    return (np.concatenate(h) if h else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))])


def neighbours(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every pair of neighbouring words (with the edge before the first and after the last) as two hashes, its document; the
    documents' numbers of words."""
    h, bounds = _words(data, offsets)
    n = np.diff(bounds)
    size = n + (n > 0)
    first = np.cumsum(size) - size
    a, b = np.full(int(size.sum()), EDGE), np.full(int(size.sum()), EDGE)
    doc_of_word = np.repeat(np.arange(len(n)), n)
    place = first[doc_of_word] + np.arange(len(h)) - bounds[:-1][doc_of_word]
    b[place] = h
    a[place + 1] = h
    return a, b, np.repeat(np.arange(len(n)), size), n


def packed_pairs(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> bytes:
    """Pairs in order of a as places in the list of their words."""
    w, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    code = code.ravel().astype(np.uint32)
    return pack(deltas(w), deltas(code[: len(a)]), code[len(a) :], c.astype(np.uint32))


def unpacked_pairs(w: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The list of words, the pairs' places in it and their counts."""
    return undeltas(w), undeltas(a).astype(np.int64), b.astype(np.int64), c.astype(np.int64)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _CONTEXT + b)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D by count (0, 1, 2, 3 and more) from the numbers of things counted 1 to 4 times."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    d = [0.0] + [k - (k + 1) * y * b / a if a else y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([min(max(x, 0.05), k - 0.05) if k else 0.0 for k, x in enumerate(d)])


class Model:
    """What holds for all words: a few numbers.  All that is kept by word or pair stays in shards.

    A word's stats are, in this order: its pairs as a context; the different ones counted once, twice, oftener; its different
    contexts.  pairs: how many pairs are counted 1 to 4 times; words: how many words have 1 to 4 contexts, 3 and more, the sum
    of the contexts, the words."""

    def __init__(self, pairs: np.ndarray, words: np.ndarray):
        self.d2, self.d1 = discounts(*pairs.tolist()), discounts(*words[:4].tolist())
        self.contexts = max(1, int(words[5]))
        freed = float(self.d1[1:] @ words[[0, 1, 4]]) / self.contexts if words[6] else 1.0
        self.unseen = freed / (int(words[6]) + 1)  # shared by the words seen and the unknown one

    def back(self, stats: np.ndarray) -> np.ndarray:
        return self.d2[1:] @ stats[1:4] / stats[0]

    def lower(self, stats: np.ndarray) -> np.ndarray:
        return (stats[4] - self.d1[np.minimum(stats[4], 3)]) / self.contexts + self.unseen

    def of_words(self, stats: np.ndarray) -> np.ndarray:
        """What a word adds to log p as a context and after one, as if its pairs were not counted."""
        return np.log(self.back(stats)) + np.log(self.lower(stats))

    def of_pairs(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """What counted pairs add to that.  a, b: their words' places in stats."""
        top = (counts - self.d2[np.minimum(counts, 3)]) / stats[0][a]
        # a word that is no context has no back-off, and stands as none here
        with np.errstate(divide="ignore", invalid="ignore"):
            back = self.back(stats)
        return np.log1p(top / (back[a] * self.lower(stats)[b]))


def train(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The model over rows (id, text, role) of role TRAIN, and its stored shards: what counted pairs and words add to log p."""
    spark = rows.sparkSession
    n = shards(spark)
    taught = rows.where(F.col("role") == TRAIN).select("id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, (_, data, offsets, _) in zip(block_names(), text_blocks(batches, limit=ASK_BYTES), strict=False):
            a, b, _, _ = neighbours(data, offsets)
            key, at, c = np.unique(pair_keys(a, b), return_index=True, return_counts=True)
            a, b, shard = a[at], b[at], key % np.uint64(n)
            order = np.lexsort((b, a, shard))
            a, b, c = a[order], b[order], c[order].astype(np.uint32)
            cuts = np.searchsorted(shard[order], np.arange(n + 1, dtype=np.uint64)).tolist()
            yield sent([(s, PAIRS, name, packed_pairs(a[x:y], b[x:y], c[x:y])) for s, (x, y) in enumerate(pairwise(cuts)) if y > x])

    def add(shard: int, values: Iterator) -> Iterator[pa.RecordBatch]:
        held, waiting, size = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0
        for _, _, arrays in values:
            w, a, b, c = unpacked_pairs(*arrays)
            waiting.append((w[a], w[b], c))
            size += len(c)
            if size > max(1 << 20, len(held[0])):
                held, waiting, size = _merged(held, waiting), [], 0
        a, b, c = _merged(held, waiting)
        yield sent([(shard, PAIRS, 0, packed_pairs(a, b, c)), (shard, ABOUT, 0, pack(np.array([(c == k).sum() for k in (1, 2, 3, 4)])))])

    pairs = stored(at_shards(taught.mapInArrow(count, SENT), add, SENT), "pairs")
    free_shuffles(spark)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, body in zip(batch.column("shard").to_pylist(), batch.column("body").to_pylist(), strict=True):
                w, a, b, c = unpacked_pairs(*unpack(body))
                start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                stats = np.zeros((5, len(w)), np.int64)
                stats[:4, a[start]] = [np.add.reduceat(x.astype(np.int64), start) for x in (c, c == 1, c == 2, c > 2)]
                stats[4] = np.bincount(b, minlength=len(w))
                yield sent(split_rows(0, shard, w, n, *stats, first=deltas))

    def reply(shard: int, values: Iterator) -> Iterator[pa.RecordBatch]:
        asked = [(pair_shard, undeltas(x[0]), np.stack(x[1:])) for _, pair_shard, x in values]
        w, back = np.unique(np.concatenate([x for _, x, _ in asked]), return_inverse=True)
        parts = np.concatenate([x for _, _, x in asked], axis=1)
        stats = np.stack([np.bincount(back, weights=x, minlength=len(w)).astype(np.int64) for x in parts])
        before = stats[4]
        about = np.array([*[(before == k).sum() for k in (1, 2, 3, 4)], (before > 2).sum(), before.sum(), len(w)])
        yield sent([(shard, WORDS, 0, pack(deltas(w), *stats)), (shard, ABOUT, 0, pack(about))])
        for pair_shard, x, _ in asked:
            yield sent([(pair_shard, REPLY, shard, pack(*stats[:, np.searchsorted(w, x)]))])  # in the order asked

    words_ = stored(at_shards(pairs.where(F.col("kind") == PAIRS).mapInArrow(tell, SENT), reply, SENT), "words")
    free_shuffles(spark)

    def told(df: DataFrame, size: int) -> np.ndarray:  # a short array a shard
        return sum((unpack(r["body"])[0] for r in df.where(F.col("kind") == ABOUT).select("body").collect()), np.zeros(size, np.int64))

    model = Model(told(pairs, 4), told(words_, 7))

    def value(shard: int, values: Iterator) -> Iterator[pa.RecordBatch]:
        counted, known, part = None, None, None
        for kind, word_shard, arrays in values:
            if kind == PAIRS:
                counted = unpacked_pairs(*arrays)
                known, part = np.zeros((5, len(counted[0])), np.int64), counted[0] % np.uint64(n)
            elif kind == REPLY:
                known[:, part == word_shard] = arrays
            else:
                yield sent([(shard, WORDS, 0, pack(arrays[0], model.of_words(np.stack(arrays[1:])).astype(np.float32)))])
        if counted is not None:
            w, a, b, c = counted
            key = pair_keys(w[a], w[b])
            by_key = np.argsort(key)
            yield sent([(shard, PAIRS, 0, pack(deltas(key[by_key]), model.of_pairs(a, b, c, known)[by_key].astype(np.float32)))])

    table = stored(at_shards(pairs.unionByName(words_).where(F.col("kind") != ABOUT), value, SENT), "values")
    discard(pairs, words_)
    free_shuffles(spark)
    return model, table


def _merged(held: tuple[np.ndarray, ...], more: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    if not more:
        return held
    a, b, c = [np.concatenate(x) for x in zip(held, *more, strict=True)]
    order = np.lexsort((b, a))
    a, b, c = a[order], b[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[at], b[at], np.add.reduceat(c, at)


NO_ID = -(1 << 63)


def _asked(key: np.ndarray, doc: np.ndarray, n: int, wide: type) -> list[tuple[np.ndarray, ...]]:
    """By shard: ascending keys (divided by n, as the shard is the remainder), how many documents have each, these documents, and how often.  doc: ascending."""
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key))).astype(np.uint32)
    key, doc = key[new], doc[new].astype(wide)
    order = np.argsort((key % np.uint64(n)).astype(np.uint16 if n <= 65536 else np.uint32), kind="stable")  # keys stay ascending within a shard
    key, doc, times = key[order], doc[order], times[order]
    cuts = np.searchsorted(key % np.uint64(n), np.arange(n + 1, dtype=np.uint64)).tolist()
    out = []
    for x, y in pairwise(cuts):
        u, uses = np.unique(key[x:y], return_counts=True)
        out.append((deltas(u // np.uint64(n)), uses.astype(np.uint32), doc[x:y], times[x:y]))
    return out


def scores(rows: DataFrame, model: Model, table: DataFrame) -> DataFrame:
    """id, lang (a hash), role, n_words, log_p of every row of rows (id, text, lang, role)."""
    spark = rows.sparkSession
    n = shards(spark)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, (ids, data, offsets, (lang, role)) in zip(block_names(), text_blocks(batches, ("lang", "role"), ASK_BYTES), strict=False):
            a, b, doc, n_words = neighbours(data, offsets)
            wide = np.uint16 if len(ids) <= 65536 else np.uint32
            pairs, words_ = _asked(pair_keys(a, b), doc, n, wide), _asked(b, doc, n, wide)  # a document's contexts are the words that follow
            out = [(s, ASK, name, pack(*p, *w, np.array([len(ids)]))) for s, (p, w) in enumerate(zip(pairs, words_, strict=True)) if len(p[0]) or len(w[0])]
            yield sent([*out, (home(name, n), HEAD, name, pack(ids, lang, role, n_words))])

    def answer(shard: int, values: Iterator) -> Iterator[pa.RecordBatch]:
        pairs = words_ = (np.zeros(0, np.uint64), np.zeros(0))

        def sums(known: tuple[np.ndarray, np.ndarray], other: float, u: np.ndarray, uses: np.ndarray, doc: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
            keys, value = known
            u = undeltas(u) * np.uint64(n) + np.uint64(shard)
            k = np.minimum(np.searchsorted(keys, u), max(0, len(keys) - 1))
            p = np.where(keys[k] == u, value[k], other) if len(keys) else np.full(len(u), other)
            return np.bincount(doc, weights=np.repeat(p, uses) * times, minlength=size)

        for kind, block, arrays in values:
            if kind == PAIRS:
                pairs = undeltas(arrays[0]), arrays[1].astype(np.float64)
            elif kind == WORDS:
                words_ = undeltas(arrays[0]), arrays[1].astype(np.float64)
            elif kind == ASK:
                size = int(arrays[8][0])
                out = sums(pairs, 0.0, *arrays[:4], size) + sums(words_, float(np.log(model.unseen)), *arrays[4:8], size)
                yield sent([(block, 1, shard, pack(out.astype(np.float32)))])
            else:
                yield sent([(block, 0, 0, pack(*arrays))])

    def total(_: int, values: Iterator) -> Iterator[pa.RecordBatch]:
        head, sums = None, 0.0
        for kind, _, arrays in values:
            if kind == 0:
                head = arrays
            else:
                sums = sums + arrays[0].astype(np.float64)
        ids, lang, role, n_words = head
        yield frame({"id": pa.int64(), "lang": pa.int64(), "role": pa.int32(), "n_words": pa.int64(), "log_p": pa.float64()}, id=ids, lang=lang, role=role, n_words=n_words, log_p=np.broadcast_to(sums, len(ids)))

    met = at_shards(rows.select("id", "text", "lang", "role").mapInArrow(ask, SENT).unionByName(table), answer, SENT)
    return at_shards(met, total, "id long, lang long, role int, n_words long, log_p double")


def judge(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", stretch: float = STRETCH) -> DataFrame:
    """id, lang, n_words, log_p, perplexity, threshold, kept of every row of docs.  trusted: a table of ids."""
    rows = marked(docs, trusted, id_col, text_col, lang_col)
    model, table = train(rows)
    found = None
    for k in range(ROUNDS):  # texts' pairs are more bytes than the texts: a part of the documents is asked for at a time
        part = stored(scores(rows.where(F.pmod(F.shiftright("id", RUN), F.lit(ROUNDS)) == k), model, table), "scores")
        found = part if found is None else found.unionByName(part)
        free_shuffles(docs.sparkSession)
    discard(table)
    log_ppl = -F.col("log_p") / (F.col("n_words") + 1)
    found = found.withColumn("x", F.when(F.col("n_words") > 0, log_ppl))
    trial = found.where((F.col("role") == TRIAL) & F.col("x").isNotNull())
    limit = lambda: (F.count("*").alias("n"), F.percentile_approx("x", [0.5, 0.95], 10_000).alias("q"))
    over = lambda q: q[0] + stretch * (q[1] - q[0])
    every = trial.agg(*limit()).first()
    fallback = over(every["q"]) if every["n"] else float("inf")
    limits = trial.groupBy("lang").agg(*limit()).where(F.col("n") >= LEAST_HELD_OUT).select("lang", over(F.col("q")).alias("limit"))
    names = docs.select(F.xxhash64(F.coalesce(docs[lang_col].cast("string"), F.lit("\0"))).alias("lang"), docs[lang_col].alias("name")).groupBy("lang").agg(F.first("name").alias("name"))
    out = found.join(limits, "lang", "left").join(names, "lang", "left")
    most = F.coalesce("limit", F.lit(fallback))
    kept = F.col("id").isNotNull() & F.coalesce(F.col("x") <= most, F.lit(False))
    return out.withColumn("id", F.nullif("id", F.lit(NO_ID))).select(F.col("id").alias(id_col), F.col("name").alias("lang"), "n_words", "log_p", F.exp("x").alias("perplexity"), F.exp(most).alias("threshold"), kept.alias("kept"))


def keep_good(docs: DataFrame, judged: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """docs without the rejected ones (and those of null id)."""
    bad = judged.where(~F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct()
    bad = stored(bad, "rejected")
    if bad.count() <= MOST_IDS:
        bad = F.broadcast(bad)
    return docs.where(docs[id_col].isNotNull()).join(bad, id_col, "left_anti").select(*docs.columns)
