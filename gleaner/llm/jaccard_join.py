"""N-gram Jaccard join with set-relation skipping (operator 1).

Texts are sets of word n-grams; two sets link at a Jaccard similarity of `least` percent or more.  Equal sets are one set.
N-grams are ordered by their frequency, rare ones first (a sketch of fixed size gives it, so equal n-grams are placed alike
in every set), and each set enters the index under the n-grams of its prefix alone: two linked sets share one of those.

An index list is cut into blocks of equal position (its n-gram's place in a set's prefix), each in order of size.  With the
n-gram at place j of a set of b and at place i >= j of one of a n-grams, they share at most j + 1 + min(a - i - 1, b - j - 1).  So
for a set and a block only a range of sizes can link: it is found by search, and a block without one is skipped whole.

Answers are derived along similar sets instead of being searched for each.  First each set of a list is only held against
a few sets of it, its pivots, for TURNS turns.  A set that links with its pivot takes over the pivot's answer, the group of sets
connected with it, and is from then on only looked up in lists that hold sets of other groups, there skipping its own group's
blocks.  So a group of thousands of near copies costs a comparison a member and not one a pair.  Nothing is lost: sets of one
group are connected already, and any other pair that could link is compared exactly.

Each set has BITS parities, one of its n-grams by a part of the hash.  Parities in which two sets differ are a lower bound of the
n-grams that only one of them has; pairs that differ in more than a link allows are not compared.

Defined cases: null and empty texts have no n-grams and link with nothing; a text of fewer words than n has one n-gram, all of
it; a row with a null id gives no row (it could name no component); repeated ids give a row each; extra columns are not
read; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .exchange import SENT, at_shards, block_names, frame, sent, shards, source, split_rows, text_blocks
from .kernel import chunks, deltas, ngrams, pack, places, text_buffers, undeltas, unpack, words
from .shared import discard, free_shuffles, hung, named, stored

CELLS, SLICES = 1 << 22, 64
#: Ids that are broadcast to pick texts; more are joined by a shuffle.
MOST_IDS = 1_000_000
#: Turns of pivots before the rest is compared pair by pair; a list's pivots; those of a set's that it is compared with in a turn.
TURNS, PIVOTS, LIKELY = 2, 32, 32
LONG_LIST, BITS = 48, 256
#: Bytes of texts in a block of the index.
BLOCK_BYTES = 8 << 20
#: Pairs of a set and a block, or of two sets, that are held at once; groups of a list that are blocks of their own.
AT_ONCE, APART = 1 << 20, 32


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Ascending n-gram hashes of every text."""
    out = []
    for lo, hi in chunks(offsets):
        g, bounds = ngrams(*words(data, offsets[lo : hi + 1], lower=True), n, short=True)
        out += [np.unique(g[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return out


def parities(sets: list[np.ndarray]) -> list[np.ndarray]:
    """BITS / 64 numbers for each set."""
    out = []
    for at in range(0, len(sets), 4096):
        part = sets[at : at + 4096]
        row = np.repeat(np.arange(len(part)), [len(x) for x in part])
        bins = row * BITS + (np.concatenate(part) >> np.uint64(24)).astype(np.int64) % BITS
        odd = np.bincount(bins, minlength=len(part) * BITS).astype(np.uint8) & 1
        out += list(np.packbits(odd.reshape(len(part), BITS), axis=1, bitorder="little").view("<i8"))
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() if len(s) else b""


def needed(a: Column | np.ndarray, b: Column | np.ndarray, least: int) -> Column | np.ndarray:
    """Shared n-grams that sets of a and b need to link."""
    return -((-least * (a + b)) // (100 + least)) if isinstance(a, np.ndarray) else F.ceil(least * (a + b) / (100 + least) - 1e-9)


def apart(pairs: DataFrame, least: int) -> DataFrame:
    """pairs (size_a, size_b, sig_a, sig_b) without those whose parities differ too often."""
    differ = sum((F.bit_count(F.col("sig_a")[k].bitwiseXOR(F.col("sig_b")[k])) for k in range(BITS // 64)), F.lit(0))
    return pairs.where(differ <= F.col("size_a") + F.col("size_b") - 2 * needed(F.col("size_a"), F.col("size_b"), least))


def prefix(a: np.ndarray, least: int) -> np.ndarray:
    return a + (-least * a) // 100 + 1


def survey(rows: DataFrame, n: int) -> DataFrame:
    """Stored rows: id, n, digest, sig of every text, and slices of each block's counts of n-grams by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, (ids, data, offsets, _) in zip(block_names(), text_blocks(batches), strict=False):
            sets = sets_of(data, offsets, n)
            names = [digest(s) for s in sets]
            once = {d: s for d, s in zip(names, sets, strict=True)}
            cells = np.zeros(CELLS, np.uint32)
            if once:
                cells = np.bincount((np.concatenate([*once.values()]) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            k = len(ids)
            parts = [pack(x.astype(np.uint32)) for x in np.split(cells, SLICES)]
            yield frame(
                {"id": pa.int64(), "n": pa.int64(), "digest": pa.binary(), "sig": pa.list_(pa.int64()), "shard": pa.int64(), "block": pa.int64(), "body": pa.binary()},
                id=[*ids.tolist(), *[None] * SLICES], n=[*map(len, sets), *[None] * SLICES], digest=[*names, *[None] * SLICES], sig=[*parities(sets), *[None] * SLICES],
                shard=[*[None] * k, *range(SLICES)], block=[*[None] * k, *[name] * SLICES], body=[*[None] * k, *parts],
            )

    return stored(rows.mapInArrow(run, "id long, n long, digest binary, sig array<long>, shard long, block long, body binary"), "sets")


def frequencies(surveyed: DataFrame) -> np.ndarray:
    """Logarithms of the counts by cell over all texts: CELLS bytes, whatever the input."""

    def add(shard: int, values: Iterator) -> Iterator[pa.RecordBatch]:
        yield sent([(shard, 0, 0, pack(sum((x[0].astype(np.int64) for _, _, x in values), np.zeros(CELLS // SLICES, np.int64))))])

    out = np.zeros((SLICES, CELLS // SLICES), np.int64)
    some = surveyed.where("body is not null").select("shard", F.lit(0).alias("kind"), "block", "body")
    for r in at_shards(some, add, SENT).collect():
        out[r["shard"]] = unpack(r["body"])[0]
    return np.ceil(4 * np.log2(out.ravel() + 1)).astype(np.uint8)


def postings(rows: DataFrame, order: np.ndarray, n: int, least: int) -> DataFrame:
    """Stored lists of two sets or more: gram, set (first 8 bytes of its digest), size, place."""
    k = shards(rows.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, (_, data, offsets, _) in zip(block_names(), text_blocks(batches, limit=BLOCK_BYTES), strict=False):
            once = {digest(s)[:8]: s for s in sets_of(data, offsets, n)}
            grams, names, sizes, places = [], [], [], []
            for d, s in once.items():
                if 100 * len(s) < least * (len(s) + 1):
                    continue  # no other set can link
                p = int(prefix(np.array([len(s)]), least)[0])
                f = order[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                grams.append(s[np.lexsort((s, f))[:p]])
                names.append(np.full(p, np.frombuffer(d, "<i8")[0]))
                sizes.append(np.full(p, len(s)))
                places.append(np.arange(p))
            if grams:
                yield sent(split_rows(0, name, np.concatenate(grams), k, np.concatenate(names), np.concatenate(sizes).astype(np.uint32), np.concatenate(places).astype(np.uint32), first=deltas))

    def lists(_: int, values: Iterator) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for _, _, (g, d, a, i) in values:
            for c, x in zip(cols, (undeltas(g), d, a.astype(np.int64), i.astype(np.int64)), strict=True):
                c.append(x)
        g, d, a, i = [np.concatenate(c) for c in cols]
        o = np.lexsort((d, a, g))
        g, d, a, i = g[o], d[o], a[o], i[o]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])  # a set of several blocks once
        g, d, a, i = g[new], d[new], a[new], i[new]
        start = np.concatenate([[True], g[1:] != g[:-1]])
        lst = np.cumsum(start) - 1
        many = np.bincount(lst)[lst] > 1
        g, d, a, i = g[many], d[many], a[many], i[many]
        yield frame({k: pa.int64() for k in ("gram", "d", "size", "place")}, gram=g.view(np.int64), d=d, size=a, place=i)

    schema = "gram long, d long, size long, place long"
    return stored(at_shards(rows.mapInArrow(index, SENT), lists, schema), "lists")


def grouped(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """The lists that still hold sets of several groups: gram, d, size, place, grp (a set without links is a group).  groups: d, component."""
    out = lists.join(groups, "d", "left").withColumn("grp", F.coalesce("component", "d")).drop("component")
    open_ = out.groupBy("gram").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).where("x <> y").select("gram")
    return out.join(open_, "gram", "left_semi")


def pivots(lists: DataFrame, turn: int, least: int) -> DataFrame:
    """Pairs (a, b): every set with the PIVOTS likeliest of its lists' pivots.  A list's pivots are its first sets in an order
    drawn anew for each turn, but alike in all lists, so that similar lists have the same ones."""
    drawn = W.partitionBy("gram").orderBy(F.xxhash64("d", F.lit(turn)), "d")
    heads = lists.withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= PIVOTS).select("gram", F.struct("d", "size", "place", "grp").alias("p"))
    both = lists.join(heads, "gram").where(F.col("grp") != F.col("p.grp"))
    bound = F.least("place", "p.place") + 1 + F.least(F.col("size") - F.col("place"), F.col("p.size") - F.col("p.place")) - 1
    both = both.where(bound >= needed(F.col("size"), F.col("p.size"), least))
    counts = both.groupBy(F.col("p.d").alias("a"), F.col("d").alias("b")).agg(F.count("*").alias("n"), F.first("p.size").alias("size_a"), F.first("size").alias("size_b"))
    likely = can_link(counts, least).withColumn("r", F.row_number().over(W.partitionBy("b").orderBy(F.desc("n"), "a"))).where(F.col("r") <= LIKELY)
    return likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _ranges(least: int, a: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest size that a set with the n-gram at place j <= i can have to link with one of a n-grams that has it at i."""
    return -((-least * a) // 100), np.minimum(100 * a // least, (100 + least) * (j + a - i) // least - a)


def near_in_lists(g: np.ndarray, i: np.ndarray, a: np.ndarray, grp: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (q, r) of all pairs of postings of one list and different groups that can link.  Postings are in order of list, place,
    group (of the lists with few groups) and size."""
    n = len(g)
    new_list = np.concatenate([[True], g[1:] != g[:-1]])
    lst = np.cumsum(new_list) - 1
    new = new_list | np.concatenate([[True], (i[1:] != i[:-1]) | (grp[1:] != grp[:-1])])
    blk = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    place_of, group_of = i[first], grp[first]
    key = (blk.astype(np.int64) << 32) + a
    low = blk[np.flatnonzero(new_list)][lst]  # the first block of the own list
    met = np.cumsum(blk - low + 1)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(met, (met[at - 1] if at else 0) + AT_ONCE, side="right")))
        r = np.repeat(np.arange(at, to), blk[at:to] - low[at:to] + 1)
        b = places(low[at:to], blk[at:to] - low[at:to] + 1)
        other = (group_of[b] != grp[r]) | (group_of[b] < 0)  # a group's own blocks are skipped
        r, b = r[other], b[other]
        least_size, most_size = _ranges(least, a[r], i[r], place_of[b])
        lo, hi = np.searchsorted(key, (b << 32) + least_size), np.searchsorted(key, (b << 32) + most_size, side="right")
        hi = np.where(b == blk[r], np.minimum(hi, r), hi)
        some = hi > lo
        r, lo, hi = r[some], lo[some], hi[some]
        pairs = np.cumsum(hi - lo)
        x = 0
        while x < len(r):
            y = max(x + 1, int(np.searchsorted(pairs, (pairs[x - 1] if x else 0) + AT_ONCE, side="right")))
            yield places(lo[x:y], (hi - lo)[x:y]), np.repeat(r[x:y], (hi - lo)[x:y])
            x = y
        at = to


def across(lists: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of sets of different groups that can still link, with their sizes; lists: gram, d, size, place, grp; known: d, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            g, d, a, i, c, sig, big, small = cols
            lst = np.cumsum(np.concatenate([[True], g[1:] != g[:-1]])) - 1
            by = np.lexsort((c, lst))
            groups = np.bincount(lst[by], weights=np.concatenate([[True], (c[by][1:] != c[by][:-1]) | (lst[by][1:] != lst[by][:-1])]))
            _, apart = np.unique(c, return_inverse=True)
            apart = np.where(groups[lst] <= APART, apart.ravel(), -1)
            order = np.lexsort((d, a, apart, i, lst))
            g, d, a, i, c, sig, big, small, apart = [x[order] for x in (g, d, a, i, c, sig, big, small, apart)]
            for q, r in near_in_lists(g, i, a, apart, least):
                some = c[q] != c[r]
                q, r = q[some], r[some]
                some = np.bitwise_count(sig[q] ^ sig[r]).sum(1, dtype=np.int64) <= a[q] + a[r] - 2 * needed(a[q], a[r], least)
                q, r = q[some], r[some]
                more = np.ones(len(q), np.int64)
                if len(q) and big[r[0]] is not None or any(big[k] is not None for k in np.unique(r).tolist()):
                    q, r, more = told_once(g, a, big, small, q, r)
                if not len(q):
                    continue
                x, y = np.minimum(d[q], d[r]), np.maximum(d[q], d[r])
                ax, ay = np.where(d[q] <= d[r], a[q], a[r]), np.where(d[q] <= d[r], a[r], a[q])
                both = np.lexsort((y, x))
                x, y, ax, ay, more = x[both], y[both], ax[both], ay[both], more[both]
                at = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
                yield frame({k: pa.int64() for k in ("a", "b", "size_a", "size_b", "n")}, a=x[at], b=y[at], size_a=ax[at], size_b=ay[at], n=np.add.reduceat(more, at))

        def told_once(g: np.ndarray, a: np.ndarray, big: np.ndarray, small: np.ndarray, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Pairs of long lists in the first one that they share, with how many n-grams they can share in all lists."""
            keep, more = np.ones(len(q), bool), np.ones(len(q), np.int64)
            cuts = np.append(np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])), len(r))
            for lo, hi in pairwise(cuts.tolist()):
                own, mine = big[r[lo]], q[lo:hi]
                if own is None:
                    continue
                sizes = np.array([len(big[k]) for k in mine])
                flat = np.concatenate([big[k] for k in mine])
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                row = np.repeat(np.arange(len(mine)), sizes)
                first_shared = np.full(len(mine), np.iinfo(np.int64).max)
                np.minimum.at(first_shared, row[hit], flat[hit])
                total = np.bincount(row[hit], minlength=len(mine)) + np.minimum(small[mine], small[r[lo]])
                size = np.full(len(mine), a[r[lo]])
                rest = np.maximum((least * a[mine] + 99) // 100, (least * size + 99) // 100) - 1  # as in can_link
                keep[lo:hi] = (first_shared == g[r[lo]]) & (total + rest >= needed(a[mine], size, least))
                more[lo:hi] = total
            return q[keep], r[keep], more[keep]

        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [b.column(k).to_numpy() for k in ("gram", "d", "size", "place", "grp")]
            grams = np.empty(b.num_rows, object)
            grams[:] = [None if x is None else np.sort(np.asarray(x, np.int64)) for x in b.column("big").to_pylist()]
            cols += [b.column("sig").flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64), grams, b.column("small").to_numpy()]
            cols = cols if held is None else [np.concatenate(z) for z in zip(held, cols, strict=True)]
            last = np.searchsorted(cols[0], cols[0][-1]) if len(cols[0]) else 0  # the last list may go on
            if last:
                yield from flush([z[:last] for z in cols])
            held = [z[last:] for z in cols]
        if held is not None and len(held[0]):
            yield from flush(held)

    n = shards(lists.sparkSession)
    # sets of long lists bring their n-grams of all long lists: a pair is then counted at once, in the first list that it shares
    long_ = lists.groupBy("gram").count().where(F.col("count") > LONG_LIST).select("gram", F.lit(1).alias("long"))
    told = lists.join(long_, "gram", "left")
    about = told.groupBy("d").agg(F.collect_list(F.when(F.col("long") == 1, F.col("gram"))).alias("big"), F.count(F.when(F.col("long").isNull(), 1)).alias("small"))
    told = told.join(about.join(known.select("d", "sig"), "d"), "d").select("gram", "d", "size", "place", "grp", "sig", F.when(F.col("long") == 1, F.col("big")).alias("big"), "small")
    near = told.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(run, "a long, b long, size_a long, size_b long, n long")
    return near.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))


def can_link(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs whose common prefix n-grams n and all of the rest would be enough.

    Of the n-grams they share, those up to the end of the prefix that ends first are in both prefixes, so in n; the others are
    all in the rest of that set.  Which of the two it is, is not kept: the greater rest holds for either."""
    rest = lambda a: F.col(a) - (F.col(a) - F.ceil(least * F.col(a) / 100 - 1e-9) + 1)
    return pairs.where(F.col("n") + F.greatest(rest("size_a"), rest("size_b")) >= needed(F.col("size_a"), F.col("size_b"), least))


def verified(pairs: DataFrame, rows: DataFrame, canon: DataFrame, n: int, least: int) -> DataFrame:
    """Stored links (a, b) between the smallest ids of the pairs' sets, by exact comparison.  canon: d, id, n, sig."""
    side = lambda x: canon.select(F.col("d").alias(x), F.col("id").alias(f"id_{x}"), F.col("n").alias(f"size_{x}"), F.col("sig").alias(f"sig_{x}"))
    pairs = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    pairs = stored(apart(pairs, least).select("a", "b", "id_a", "id_b"), "candidates")
    ids = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("d"), F.col("id_a").alias("id")), F.struct(F.col("b").alias("d"), F.col("id_b").alias("id")))).alias("x")).select("x.*").distinct()
    pick = ids if ids.count() > MOST_IDS else F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            found = sets_of(data, offsets, n)
            own = pa.array([int.from_bytes(digest(x)[:8], "little", signed=True) == d for x, d in zip(found, b.column("d").to_pylist(), strict=True)], pa.bool_())  # ids may repeat
            yield frame({"d": pa.int64(), "s": pa.binary()}, d=b.column("d"), s=[x.astype("<u8").tobytes() for x in found]).filter(own)

    full = rows.join(pick, "id").select("d", "text").mapInArrow(run, "d long, s binary")
    both = pairs.join(full.select(F.col("d").alias("b"), F.col("s").alias("s_b")), "b").join(full.select(F.col("d").alias("a"), F.col("s").alias("s_a")), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("s_a").to_pylist(), b.column("s_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= least * (len(x) + len(y) - both))
            mask = pa.array(ok, pa.bool_())
            yield frame({"a": pa.int64(), "b": pa.int64()}, a=b.column("id_a").filter(mask), b=b.column("id_b").filter(mask))

    out = stored(both.select("id_a", "id_b", "s_a", "s_b").mapInArrow(compare, "a long, b long"), "links")
    discard(pairs)
    return out


def join(docs: DataFrame, *, n: int = 5, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every document with an id.  least: the similarity in percent."""
    spark = docs.sparkSession
    rows = source(docs, id_col, text_col)
    surveyed = survey(rows, n)
    order = frequencies(surveyed)
    about = surveyed.where("body is null").select("id", "n", "digest", "sig")
    canon = about.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    canon = stored(canon.select("digest", "id", signed("digest").alias("d"), "n", "sig"), "canon")
    lists = postings(rows, order, n, least)
    free_shuffles(spark)
    known = canon.select("d", "id", "n", "sig")
    edges, open_ = None, lists.withColumn("grp", F.col("d"))
    for turn in range(TURNS + 1):
        likely = pivots(open_, turn, least) if turn < TURNS else can_link(across(open_, known, least), least)
        found = verified(likely, rows, known, n, least)
        spent = edges, found, open_
        edges = hung(found if edges is None else found.unionByName(edges), 2 if turn < TURNS else None)
        if turn < TURNS:  # groups may still be parts of what is connected: their members are only compared oftener
            open_ = stored(grouped(lists, known.join(named(edges), "id").select("d", "component")), "open")
        discard(*spent)
        free_shuffles(spark)
    final = named(edges)
    out = about.join(canon.select("digest", F.col("id").alias("first")), "digest", "left").join(final.select(F.col("id").alias("first"), "component"), "first", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "first", "id").alias("component_id"))


def signed(column: str) -> Column:
    """The first 8 bytes of a binary column as a little-endian signed long."""
    x = F.hex(column)
    swapped = F.concat(*[F.substring(x, 2 * k + 1, 2) for k in range(7, -1, -1)])
    high, low = F.conv(F.substring(swapped, 1, 8), 16, 10).cast("long"), F.conv(F.substring(swapped, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def representatives(docs: DataFrame, joined: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group: the one of the smallest id.  joined: rows of join().

    Rows of a null id, which no group could name, go; of rows of one id and text one stays."""
    ids = stored(joined.where(F.col("component_id") == F.col(id_col)).select(F.col(id_col).alias("id")).distinct(), "kept")
    ids = ids if ids.count() > MOST_IDS else F.broadcast(ids)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("body"))
    kept = whole.join(ids, "id", "left_semi")
    twice = stored(kept.groupBy("id", "body").count().where("count > 1").select("id", "body"), "repeated")
    n = twice.count()
    if not n:
        return kept.select("row.*")
    twice = twice if n > MOST_IDS else F.broadcast(twice)
    once = kept.join(twice, ["id", "body"], "left_semi").groupBy("id", "body").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.join(twice, ["id", "body"], "left_anti").select("row.*").unionByName(once.select("row.*"))
