"""Substring deduplication with a compressed FM-index in each shard (operator 8).

A window is `size` consecutive words of one document; a word is removed if a window over it also starts in a document of
smaller id.  Equal windows choose the same word 4-gram as their minimizer, so windows are dealt to shards by minimizer:

1. Every text sends its minimizers to their shards, which send back those that two documents or more have.
2. Stretches of words around such minimizers (each different stretch of a block once) go to the minimizer's shard.
3. The shard builds an FM-index over the stretches of the earliest document of each minimizer: a suffix order, the
   Burrows-Wheeler transform in a wavelet matrix of packed bits with block counts, and each suffix's document; neither the text nor
   the suffixes are kept.  Later documents' stretches stream by from their last word to the first.  Backward search over the
   wavelet matrix gives each position's matching statistic, how many words from there on are in the index, up to the window size: a
   step takes one more word in, or shortens the match at its end until the word fits.  Where the statistic reaches the size, the
   interval of suffixes gives the smallest id that holds the window.
4. What the earliest documents do not have, later ones may still share: the runs of windows below the threshold are the text of
   a second index, through which they stream likewise.
5. Windows found in a smaller document go back to their texts.

Minimizers that one document alone has cannot take part, so most text is never indexed.  Shards take what the keys give them;
a passage of very many documents reaches a shard once for each block of texts, and is searched once.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing; a row with a null id gives no
row (it is neither smaller nor larger than another); rows of equal id are not smaller than each other, and repeated rows give a
row each; extra columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import SENT, at_shards, block_names, frame, home, sent, shards, split_rows, text_blocks
from .kernel import chunks, deltas, mix, ngrams, pack, places, text_buffers, undeltas, unpack, words
from .shared import free_shuffles, stored

GRAM, ORDER = 4, 16
#: Stretches that stream by at once.
STREAM = 32_768
HOT = "id long, mark long, hot binary"


class FMIndex:
    """Over sequences of words (any integers), for matches of at most `most` < ORDER words that end within a sequence."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, owner: np.ndarray, most: int):
        """owner: a number for each sequence; searches give the least over the sequences that hold a pattern."""
        self.most = most
        self.names, codes = np.unique(tokens, return_inverse=True)
        n = len(tokens) + len(lengths)
        text = np.zeros(n, np.int64)  # 0 ends a sequence
        place = np.arange(len(tokens)) + np.repeat(np.arange(len(lengths)), lengths)
        text[place] = codes.ravel() + 1
        rank = text
        width = 1
        while width < ORDER:  # order of the first 1, 2, 4, ... words
            after = np.concatenate([rank[width:], np.zeros(width, np.int64)])
            _, rank = np.unique(rank * (int(rank.max()) + 1 if n else 1) + after, return_inverse=True)
            rank = rank.ravel()
            width *= 2
        order = np.argsort(rank, kind="stable")
        self.owner = np.repeat(owner, lengths + 1)[order]
        # of each suffix and the one before it: how many words are alike
        self.common = np.zeros(n, np.uint8)
        alike = np.ones(max(0, n - 1), bool)
        for k in range(most):
            at = np.minimum(order + k, n - 1)
            alike &= (text[at[1:]] == text[at[:-1]]) & (text[at[1:]] > 0)
            self.common[1:] += alike
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.levels = max(1, int(len(self.names) + 1).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.names) + 1))])
        self.bits, self.counts, self.zeros = [], [], []
        row = text[order - 1].astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            b = ((row >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(b, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.uint32))
            self.zeros.append(int(len(b) - b.sum()))
            row = np.concatenate([row[~b], row[b]])
        self.base = np.zeros(len(self.names) + 1, np.int64)
        self.base = self._walk(np.arange(len(self.names) + 1), self.base)

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            at = i >> 6
            one = self.counts[k][at] + np.bitwise_count(self.bits[k][at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            i = np.where((symbol >> level) & 1, self.zeros[k] + one, i - one)
        return i

    def shortened(self, lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the suffixes that share the first `length` words with the one at lo."""
        if length not in self.bounds:
            new = np.append(self.common < length, True)
            at = np.arange(len(new), dtype=np.int32)
            start = np.maximum.accumulate(np.where(new, at, 0))[:-1]
            end = np.minimum.accumulate(np.where(new, at, len(new) - 1)[::-1])[::-1][1:]
            self.bounds[length] = start, end
        start, end = self.bounds[length]
        return start[lo].astype(np.int64), end[lo].astype(np.int64)

    def statistics(self, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each position of the sequences: how many words from there on, up to `most`, are in the index, and their interval."""
        n, whole = len(tokens), len(self.owner)
        stat, low, high = np.zeros(n, np.uint8), np.zeros(n, np.int32), np.zeros(n, np.int32)
        if not whole or not n:
            return stat, low, high
        k = np.searchsorted(self.names, tokens)
        symbols = np.where(self.names[np.minimum(k, len(self.names) - 1)] == tokens, k + 1, 0)
        by = np.argsort(-lengths, kind="stable")
        ends, sizes = (np.cumsum(lengths) - 1)[by], lengths[by]
        lo, hi, length = np.zeros(len(by), np.int64), np.full(len(by), whole, np.int64), np.zeros(len(by), np.int64)
        for step in range(int(sizes[0])):
            m = int(np.searchsorted(-sizes, -step, side="left"))  # sequences with a word left
            at = ends[:m] - step
            s = symbols[at]
            full = np.flatnonzero(length[:m] == self.most)
            if len(full):
                lo[full], hi[full] = self.shortened(lo[full], self.most - 1)
                length[full] -= 1
            lost = np.flatnonzero(s == 0)
            lo[lost], hi[lost], length[lost] = 0, whole, 0
            todo = np.flatnonzero(s)
            while len(todo):
                c = s[todo]
                a = self.first[c] + self._walk(c, lo[todo]) - self.base[c]
                b = self.first[c] + self._walk(c, hi[todo]) - self.base[c]
                ok = b > a
                done, todo = todo[ok], todo[~ok]
                lo[done], hi[done] = a[ok], b[ok]
                length[done] += 1
                length[todo] -= 1
                for size in np.unique(length[todo]).tolist():
                    who = todo[length[todo] == size]
                    lo[who], hi[who] = self.shortened(lo[who], size) if size else (0, whole)
            stat[at], low[at], high[at] = length[:m], lo[:m], hi[:m]
        return stat, low, high

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least owner of each interval, none empty; intervals are equal or apart, as of patterns of one size."""
        if not len(lo):
            return np.zeros(0, np.int64)
        u, first, back = np.unique(lo, return_index=True, return_inverse=True)
        padded = np.append(self.owner, np.iinfo(np.int64).max)
        return np.minimum.reduceat(padded, np.stack([u, hi[first]], 1).ravel())[::2][back.ravel()]


def stretch_names(h: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of stretches of words."""
    m = mix(h ^ np.uint64(0xA5A5))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(m * np.arange(1, len(h) + 1, dtype=np.uint64), dtype=np.uint64)])
    plain = np.concatenate([np.zeros(1, np.uint64), np.cumsum(m, dtype=np.uint64)])
    inner = sums[at + length] - sums[at] - (plain[at + length] - plain[at]) * at.astype(np.uint64)
    return mix(inner + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ mix(plain[at + length] - plain[at])


def least_owners(t: np.ndarray, length: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """For every window of the stretches (words t, one minimizer each): the least owner of a stretch that holds it."""
    begin = np.cumsum(length) - length
    grams = ngrams(t, np.array([0, len(t)]), GRAM)[0]
    key = np.min([grams[begin + k] for k in range(size - GRAM + 1)], axis=0)
    order = np.lexsort((owner, key))
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    earliest = np.zeros(len(key), np.int64)
    earliest[order] = owner[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    early = owner == earliest
    windows = length - size + 1
    start = np.cumsum(windows) - windows
    out = np.repeat(owner, windows)

    def through(fm: FMIndex, at: np.ndarray, n: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Streams sequences (first words, numbers of words, first windows) by; which of their windows the index lacks."""
        lacks = []
        for x in range(0, len(at), STREAM):
            some = slice(x, x + STREAM)
            count = n[some] - size + 1
            stat, lo, hi = fm.statistics(t[places(at[some], n[some])], n[some])
            inner = places(np.cumsum(n[some]) - n[some], count)
            window = places(where[some], count)
            hit = stat[inner] >= size
            out[window[hit]] = np.minimum(out[window[hit]], fm.least_owner(lo[inner][hit], hi[inner][hit]))
            lacks.append(window[~hit])
        return np.concatenate(lacks) if lacks else np.zeros(0, np.int64)

    fm = FMIndex(t[places(begin[early], length[early])], length[early], owner[early], size)
    lacks = np.sort(through(fm, begin[~early], length[~early], start[~early]))
    del fm
    if len(lacks):
        of = np.searchsorted(start, lacks, side="right") - 1
        first = np.flatnonzero(np.concatenate([[True], (lacks[1:] != lacks[:-1] + 1) | (of[1:] != of[:-1])]))
        count = np.diff(np.append(first, len(lacks)))
        of = of[first]
        at, n = begin[of] + lacks[first] - start[of], count + size - 1
        through(FMIndex(t[places(at, n)], n, owner[of], size), at, n, lacks[first])
    return out


def _block_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [words(data, offsets[lo : hi + 1]) for lo, hi in chunks(offsets)]
    h = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    return h, np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]) if parts else np.zeros(0, np.int64))])


def stretches(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: the document, first word and number of windows of each, and the minimizer's hash."""
    n = np.maximum(np.diff(bounds) - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = bounds[:-1][doc] + np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    if not len(at):
        return doc, at, at, np.zeros(0, np.uint64)
    g = ngrams(h, np.array([0, len(h)]), GRAM)[0]
    best, place = g[at], at.copy()
    for s in range(1, size - GRAM + 1):
        other = g[at + s]
        less = other < best
        best, place = np.where(less, other, best), np.where(less, at + s, place)
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])]))
    return doc[first], at[first], np.diff(np.append(first, len(at))), best[first]


def shared_minimizers(rows: DataFrame, size: int) -> DataFrame:
    """Texts (id, mark) with the hashes of their minimizers that other rows have as well."""
    n = shards(rows.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, (ids, data, offsets, (mark,)) in zip(block_names(), text_blocks(batches, ("mark",)), strict=False):
            doc, _, _, key = stretches(*_block_words(data, offsets), size)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(key) else np.zeros(0, bool)
            wide = np.uint16 if len(ids) <= 65536 else np.uint32
            yield sent([(home(name, n), 2, name, pack(ids, mark)), *split_rows(1, name, key[new], n, doc[new].astype(wide), first=deltas)])

    def meet(shard: int, values: Iterator) -> Iterator[pa.RecordBatch]:
        keys, blocks, docs = [], [], []
        for kind, block, arrays in values:
            if kind == 2:
                yield sent([(block, 0, 0, pack(*arrays))])
            else:
                keys.append(undeltas(arrays[0]))
                docs.append(arrays[1].astype(np.uint32))
                blocks.append(np.full(len(docs[-1]), block, np.int64))
        if not keys:
            return
        k, b, d = np.concatenate(keys), np.concatenate(blocks), np.concatenate(docs)
        order = np.argsort(k, kind="stable")
        s = k[order]
        twice = np.zeros(len(s), bool)
        if len(s) > 1:
            same = s[1:] == s[:-1]
            twice[1:] |= same
            twice[:-1] |= same
        order = np.sort(order[twice])  # by block again
        k, b, d = k[order], b[order], d[order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])), len(b)) if len(b) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield sent([(int(b[lo]), 1, shard, pack(deltas(k[lo:hi]), d[lo:hi]))])

    def back(_: int, values: Iterator) -> Iterator[pa.RecordBatch]:
        head, keys, docs = None, [], []
        for kind, _, arrays in values:
            if kind == 0:
                head = arrays
            else:
                keys.append(undeltas(arrays[0]))
                docs.append(arrays[1])
        if keys:
            k, d = np.concatenate(keys), np.concatenate(docs).astype(np.int64)
            order = np.lexsort((k, d))
            k, d = k[order], d[order]
            u, first = np.unique(d, return_index=True)
            ends = np.append(first[1:], len(d))
            yield frame({"id": pa.int64(), "mark": pa.int64(), "hot": pa.binary()}, id=head[0][u], mark=head[1][u], hot=[pack(deltas(k[a:b])) for a, b in zip(first.tolist(), ends.tolist(), strict=True)])

    met = at_shards(rows.select("id", "text", "mark").mapInArrow(ask, SENT), meet, SENT)
    return at_shards(met, back, HOT).groupBy("id", "mark").agg(F.first("hot").alias("hot"))


def found_windows(rows: DataFrame, size: int) -> DataFrame:
    """rows: id, text, mark, hot.  Texts (id, mark) with the first words of their windows that a smaller document holds."""
    n = shards(rows.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, (ids, data, offsets, (mark, hot)) in zip(block_names(), text_blocks(batches, ("mark", "hot")), strict=False):
            h, bounds = _block_words(data, offsets)
            doc, at, count, key = stretches(h, bounds, size)
            keep = np.zeros(len(doc), bool)
            cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
            for i, x in enumerate(hot):
                wanted = undeltas(unpack(x)[0])
                mine = key[cuts[i] : cuts[i + 1]]
                keep[cuts[i] : cuts[i + 1]] = wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine
            doc, at, count, key = doc[keep], at[keep], count[keep], key[keep]
            # equal stretches once
            length = count + size - 1
            name_of = stretch_names(h, at, length)
            _, first, kind = np.unique(name_of, return_index=True, return_inverse=True)
            kind = kind.ravel()
            least = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(least, kind, ids[doc])
            out = [(home(name, n), 2, name, pack(ids, mark, kind.astype(np.uint32), doc.astype(np.uint32), (at - bounds[:-1][doc]).astype(np.uint32)))]
            shard = (key[first] % np.uint64(n)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[by], np.arange(n + 1))
            for s in range(n):
                mine = by[ends[s] : ends[s + 1]]
                if len(mine):
                    size_ = length[first[mine]]
                    where = np.repeat(at[first[mine]] - (np.cumsum(size_) - size_), size_) + np.arange(int(size_.sum()))
                    u, code = np.unique(h[where], return_inverse=True)
                    out.append((s, 1, name, pack(deltas(u), code.ravel().astype(np.uint32), size_.astype(np.uint16), least[mine], mine.astype(np.uint32))))
            yield sent(out)

    def index(shard: int, values: Iterator) -> Iterator[pa.RecordBatch]:
        tokens, lengths, owners, blocks, numbers = [], [], [], [], []
        for kind, block, arrays in values:
            if kind == 2:
                yield sent([(block, 0, 0, pack(*arrays))])
                continue
            u, code, size_, least, mine = arrays
            tokens.append(undeltas(u)[code])
            lengths.append(size_.astype(np.int64))
            owners.append(least)
            blocks.append(np.full(len(mine), block, np.int64))
            numbers.append(mine)
        if not tokens:
            return
        t, length, owner, block, number = [np.concatenate(x) for x in (tokens, lengths, owners, blocks, numbers)]
        del tokens, lengths, owners
        begin = np.cumsum(length) - length
        _, first, same = np.unique(stretch_names(t, begin, length), return_index=True, return_inverse=True)  # those of other blocks once
        same = same.ravel()
        smallest = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(smallest, same, owner)
        found = least_owners(t[places(begin[first], length[first])], length[first], smallest, size)
        del t
        count = (length - size + 1)[first]
        ends = np.cumsum(count)
        cuts = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(block))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mine = same[lo:hi]
            yield sent([(int(block[lo]), 1, shard, pack(number[lo:hi], count[mine].astype(np.uint16), found[places(ends[mine] - count[mine], count[mine])]))])

    def back(_: int, values: Iterator) -> Iterator[pa.RecordBatch]:
        head, found = None, []
        for kind, _, arrays in values:
            if kind == 0:
                head = arrays
            else:
                found.append(arrays)
        if not found:
            return
        ids, mark, kind, doc, at = head
        number, count, least = [np.concatenate(x) for x in zip(*found, strict=True)]
        count = count.astype(np.int64)
        first, size_of = np.zeros(int(kind.max()) + 1, np.int64), np.zeros(int(kind.max()) + 1, np.int64)
        first[number], size_of[number] = np.cumsum(count) - count, count
        c = size_of[kind]
        ramp = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        d, start = np.repeat(doc, c), np.repeat(at, c) + ramp
        gone = least[np.repeat(first[kind], c) + ramp] < ids[d]
        d, start = d[gone], start[gone]
        order = np.lexsort((start, d))
        d, start = d[order], start[order]
        u, lo = np.unique(d, return_index=True)
        hi = np.append(lo[1:], len(d))
        if len(u):
            yield frame({"id": pa.int64(), "mark": pa.int64(), "hot": pa.binary()}, id=ids[u], mark=mark[u], hot=[pack(deltas(start[a:b].astype(np.int64))) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])

    met = at_shards(rows.select("id", "text", "mark", "hot").mapInArrow(ask, SENT), index, SENT)
    return at_shards(met, back, HOT).groupBy("id", "mark").agg(F.first("hot").alias("starts"))


def removals(docs: DataFrame, *, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, starts (packed; null: none) of every row with an id: the windows to remove."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("mark")).where("id is not null")
    hot = stored(shared_minimizers(rows, size), "minimizers")
    free_shuffles(docs.sparkSession)
    starts = stored(found_windows(rows.join(hot, ["id", "mark"]), size), "windows")
    free_shuffles(docs.sparkSession)
    return rows.join(starts, ["id", "mark"], "left").select("id", "text", "starts")


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words the windows cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change[:-1]) > 0


def dedup(docs: DataFrame, *, size: int = 13, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of every document; with texts also kept, the words that stay, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffers(b.column("text"))
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            for i, starts in enumerate(b.column("starts").to_pylist()):
                w = data[offsets[i] : offsets[i + 1]].tobytes().split()  # bytes are split at 0x20 and 0x09-0x0D
                n = len(w)
                if starts is not None:
                    gone = covered(n, undeltas(unpack(starts)[0]), size)
                    w = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
                kept = b" ".join(w)
                for k, v in (("n_words", n), ("n_removed", n - len(w)), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept.decode() if texts else None)):
                    out[k].append(v)
            yield frame({"id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}, id=b.column("id").to_pylist(), **out)

    out = removals(docs, size=size, id_col=id_col, text_col=text_col).mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    out = out.withColumnRenamed("id", id_col)
    return out if texts else out.drop("kept")
