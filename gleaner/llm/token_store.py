"""Content-addressed store of token ids (operator 4).

Layout below one folder of any store that Spark reaches:

    packs/     chunk, n, payload, refs: payload is set in the one row that stores the chunk, refs say where it is used
    recipes/   doc_id, uid, start, n_tokens, chunks: in ascending doc_id order over and within the files
    manifest/  one row for each bucket of recipes with its Merkle node, and the root

A rolling hash over the last WINDOW ids cuts each document's ids into chunks, so equal passages give equal chunks
wherever they stand.  A task stores a chunk once and lists its uses, so a chunk that very many documents share costs
one small row a task; a shuffle by chunk name leaves one payload in the store.  Reading recomputes every chunk's name
from its payload and every Merkle node from the recipes, and fails if one differs.

Defined cases: a null text is empty (its document holds the end id alone); a null id sorts first; repeated rows are
documents of their own, one after another; extra columns are not read; no documents make an empty store.
"""

from __future__ import annotations

import functools
import hashlib
import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .kernel import chunks, give_back, lowered, mix, places, span_hashes, squeeze, text_buffers, unsqueeze, word_spans
from .shared import free_shuffles, parts, prefix_sums

WINDOW, MASK, LEAST, MOST = 8, (1 << 10) - 1, 128, 8192
FLUSH_BYTES = 16 << 20
CACHE, CHUNK = 2_500_000, 2 << 20
_ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
_coders: dict[str, Coder] = {}


#: What the tokenizers file has to say for words to be encoded one by one: letters are lowered, white space parts words and is dropped.
LOWERING = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PARTING = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Coder:
    """A tokenizer with the ids of the words met so far: word hashes in order, and each word's stretch of one pool of ids.

    Words met lately are a short list beside the long one, and join it when they are a quarter of it."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        split = (told["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if (told["normalizer"] or {}).get("normalizers") != LOWERING or split[0].get("pattern") != {"Regex": PARTING} or not split[0].get("invert") or split[0].get("behavior") != "Removed":
            raise ValueError(f"{path}: this tokenizer may join over white space or tell cases apart")
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = [e.ids for e in self.tokenizer.encode_batch_fast([".", ","], add_special_tokens=False)]
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.long, self.short = none, none
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each hash's ids start and how many they are, and whether it is known."""
        at, size, known = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        for keys, starts, sizes in (self.long, self.short):
            if len(keys):
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[k] == h
                at[hit], size[hit] = starts[k[hit]], sizes[k[hit]]
                known |= hit
        return at, size, known

    def insert(self, h: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Takes in hashes that are not known yet."""
        self.short = _merged(self.short, (h, at, size))
        if 4 * len(self.short[0]) > len(self.long[0]):
            self.long, self.short = _merged(self.long, self.short), (h[:0], at[:0], size[:0])

    def learn(self, names: np.ndarray, b: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        """Takes in new words, the stretches of the bytes b from starts to before stops.  As the library lowers letters and parts a
        full stop or comma from a letter or digit before it, ASCII words are encoded once without case and such an end."""
        wide = np.concatenate([[0], np.cumsum(b >= 128)])
        plain = wide[stops] == wide[starts]
        low, last = lowered(b), b[stops - 1]
        apart = plain & (stops - starts > 1) & _ALNUM[b[stops - 2]]
        tail = np.where(apart & (last == 46), 1, np.where(apart & (last == 44), 2, 0))
        stops = stops - (tail > 0)
        h = np.where(plain, span_hashes(low, starts, stops), span_hashes(b, starts, stops))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        new = np.flatnonzero(~self.find(u)[2])
        some = first[new]
        low, raw = low.tobytes(), b.tobytes()
        base = [(low if p else raw)[x:y].decode() for p, x, y in zip(plain[some].tolist(), starts[some].tolist(), stops[some].tolist(), strict=True)]
        self.insert(u[new], *self.encoded(base))
        at, size, _ = self.find(u)
        at, size = at[back], size[back]
        for t in (1, 2):
            if len(who := np.flatnonzero(tail == t)):
                end = self.ends[t - 1]
                extra = len(end)
                grown = size[who] + extra
                start = np.cumsum(grown) - grown
                more = np.empty(int(grown.sum()), np.uint32)
                more[places(start, size[who])] = self.pool[places(at[who], size[who])]
                for j in range(extra):
                    more[start + size[who] + j] = end[j]
                at[who] = self.append(more, grown)
                size[who] = grown
        fresh = ~self.find(names)[2]
        self.insert(names[fresh], at[fresh], size[fresh])

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text start in the pool and how many they are."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(texts), 20_000):
            rows = [e.ids for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 20_000], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, rows), np.int64, len(rows)))
            ids.append(np.fromiter(chain.from_iterable(rows), np.uint32, int(sizes[-1].sum())))
        size = np.concatenate(sizes)
        return self.append(np.concatenate(ids), size), size

    def append(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool) // 2, len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(size) - size
        self.used += len(ids)
        return at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and where each one's start.  The vocabulary's splitter never joins over white space, so each run
        of other characters is encoded by the library once and kept."""
        if len(self.long[0]) > CACHE:
            self.clear()
        h, bounds, starts, ends = word_spans(data, offsets)
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        at, size, known = self.find(u)
        if not known.all():
            who = first[~known]
            self.learn(u[~known], data[offsets[0] : offsets[-1]], starts[who], ends[who] + 1)
            at, size, _ = self.find(u)
        size = size[back]
        return self.pool[places(at[back], size)], np.concatenate([[0], np.cumsum(size)])[bounds]


def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    both = [np.concatenate(x) for x in zip(a, b, strict=True)]
    order = np.argsort(both[0], kind="stable")
    return tuple(x[order] for x in both)


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def cut(ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Content-defined chunks of documents' ids, one document after the other: the document, the chunk's number in it, its first id
    and the one after its last.  A cut follows where the hash of the last WINDOW ids ends in zeros, at least LEAST and at most MOST
    ids after the last."""
    n = len(ids)
    m = mix(ids.astype(np.uint64) + np.uint64(1))
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW if n >= WINDOW else 0):
        h[WINDOW - 1 :] += m[k : n - WINDOW + 1 + k] * np.uint64(2 * k * k + 3 * k + 1 | 1)
    marks = (np.flatnonzero((mix(h) & np.uint64(MASK)) == 0) + 1).tolist()  # a window over two documents is nearer than LEAST to the second one's start
    for doc, (at, end) in enumerate(pairwise(starts.tolist())):
        seq = 0
        while at < end:
            to = end
            if end - at > LEAST:
                k = bisect_left(marks, at + LEAST)
                to = min(marks[k] if k < len(marks) else end, at + MOST, end)
            yield doc, seq, at, to
            at, seq = to, seq + 1


def _crc_multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the CRC-32 polynomial, bits reflected."""
    a, b, p = a.astype(np.uint64), b.astype(np.uint64).copy(), np.zeros(len(a), np.uint64)
    for bit in range(31, -1, -1):
        p ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ np.uint64(0xEDB88320), b >> np.uint64(1))
    return p


def _crc_powers(size: np.ndarray) -> np.ndarray:
    """x^(8 size) of each size in bytes."""
    left, power = size.astype(np.uint64), np.full(len(size), 0x80000000, np.uint64)  # x^0
    step = np.full(1, 0x00800000, np.uint64)  # x^8
    while left.any():
        power = np.where(left & np.uint64(1), _crc_multiply(power, np.broadcast_to(step, power.shape)), power)
        step = _crc_multiply(step, step)
        left >>= np.uint64(1)
    return power


@functools.cache
def _chunk_powers() -> np.ndarray:
    """The powers for chunks of 0 to MOST ids."""
    return _crc_powers(4 * np.arange(MOST + 1))


def crc_join(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of A+B from those of A and B and the bytes of B, as vectors."""
    whole = len(size) and not (size % 4).any() and size.max() <= 4 * MOST
    power = _chunk_powers()[size.astype(np.int64) // 4] if whole else _crc_powers(size)
    return _crc_multiply(power, first) ^ second.astype(np.uint64)


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text of docs and stores the ids below path.  tokenizer: the place of a tokenizers file on every machine."""
    spark = docs.sparkSession

    schema = "chunk binary, n int, payload binary, refs array<struct<doc_id: long, uid: long, seq: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = coder(tokenizer)
        task, count = TaskContext.get().partitionId() << 33, 0
        held: dict[bytes, list] = {}
        size = 0

        def flushed() -> pa.RecordBatch:
            names, (sizes, payloads, refs) = list(held), zip(*held.values(), strict=True)
            doc, uid, seq = zip(*chain.from_iterable(refs), strict=True)
            uses = pa.StructArray.from_arrays([pa.array(doc, pa.int64()), pa.array(uid, pa.int64()), pa.array(seq, pa.int32())], names=["doc_id", "uid", "seq"])
            starts = np.concatenate([[0], np.cumsum([len(x) for x in refs])])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(payloads, pa.binary()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), uses)], names=["chunk", "n", "payload", "refs"])

        for df in batches:
            ids = df.column(0).to_pylist()
            data, offsets = text_buffers(df.column(1))
            for at, to in chunks(offsets, CHUNK):
                tokens, cuts = c.encode(data, offsets[at : to + 1])
                starts = cuts + np.arange(len(cuts))  # each document has the end id as well
                x = np.full(int(starts[-1]), end_id, "<u4")
                x[places(starts[:-1], np.diff(cuts))] = tokens
                raw = memoryview(x.tobytes())
                for doc, seq, a, b in cut(x, starts):
                    name = hashlib.blake2b(raw[4 * a : 4 * b], digest_size=16).digest()
                    if name not in held:
                        p = squeeze(np.ascontiguousarray(x[a:b].view(np.uint8).reshape(-1, 4).T).tobytes())
                        held[name] = [b - a, p, []]
                        size += len(p) + 300
                    held[name][2].append((ids[at + doc], task + count + doc, seq))
                    size += 120
                count += to - at
                if size > FLUSH_BYTES:
                    yield flushed()
                    held.clear()
                    size = 0
            give_back()
        if held:
            yield flushed()
        held.clear()
        give_back()

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    made = src.mapInArrow(run, schema)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column("chunk")
            new = pa.concat_arrays([pa.array([names[0].as_py() != last]), pc.not_equal(names[1:], names[:-1])])
            last = names[-1].as_py()
            yield pa.RecordBatch.from_arrays([names, b.column("n"), pc.if_else(new, b.column("payload"), pa.nulls(len(names), pa.binary())), b.column("refs")], names=["chunk", "n", "payload", "refs"])

    made = made.repartition(parts(spark), "chunk").sortWithinPartitions("chunk").mapInArrow(once, made.schema)
    made.write.option("compression", "uncompressed").parquet(f"{path}/packs")
    del made
    free_shuffles(spark)
    uses = spark.read.parquet(f"{path}/packs").select("chunk", "n", F.explode("refs").alias("r")).select("chunk", "n", "r.*")
    recipes = uses.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("seq", "chunk", "n"))).alias("chunks"), F.sum("n").alias("n_tokens"))
    # doc ids in order, equal ids by uid; null first
    recipes = recipes.withColumn("place", F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))))
    n = max(64, parts(spark))
    splits = recipes.select("place").approxQuantile("place", [i / n for i in range(n + 1)], 0.1 / n)
    splits = sorted({int(x) for x in splits[1:-1]})
    bucket = F.size(F.filter(F.array(*map(F.lit, splits)).cast("array<long>"), lambda x: x <= F.col("place")))
    recipes = recipes.withColumn("bucket", bucket)
    sums = {r["bucket"]: r["s"] for r in recipes.groupBy("bucket").agg(F.sum("n_tokens").alias("s")).collect()}  # a row a bucket
    base, at = [], 0
    for k in sorted(sums):
        base.append((k, at))
        at += sums[k]
    base = F.broadcast(spark.createDataFrame(base, "bucket int, base long"))
    w = W.partitionBy("bucket").orderBy("place", "uid")
    recipes = recipes.join(base, "bucket").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    recipes = recipes.withColumn("chunks", F.col("chunks.chunk")).select("doc_id", "uid", "start", "n_tokens", "chunks", "bucket")
    recipes.repartitionByRange(max(1, len(sums)), "bucket").sortWithinPartitions("start").write.parquet(f"{path}/recipes")
    nodes(spark, path).coalesce(1).write.parquet(f"{path}/manifest")


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """Merkle nodes of the recipes by bucket: leaves are documents, a node covers those that start within 1,048,576 ids, one of a bucket its nodes, the root the buckets.  The last row is the root."""
    leaf = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "n_tokens", F.concat_ws(",", F.transform("chunks", F.hex))), 256)
    r = spark.read.parquet(f"{path}/recipes").select("bucket", "start", leaf.alias("leaf"))
    lo = r.groupBy("bucket").agg(F.min("start").alias("lo"))
    low = r.join(F.broadcast(lo), "bucket").withColumn("group", F.floor((F.col("start") - F.col("lo")) / 1_048_576))
    join_up = lambda value, order: F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value])), 256)
    mid = low.groupBy("bucket", "group").agg(join_up("leaf", "start").alias("node"))
    top = mid.groupBy("bucket").agg(join_up("node", "group").alias("node"))
    root = top.agg(join_up("node", "bucket").alias("node")).select(F.lit(None).cast("int").alias("bucket"), "node")
    return top.unionByName(root)


def verify(spark: SparkSession, path: str) -> None:
    """Fails if the recipes are not those that the manifest names."""
    told = {r["bucket"]: r["node"] for r in spark.read.parquet(f"{path}/manifest").collect()}  # a row a bucket, and the root
    found = {r["bucket"]: r["node"] for r in nodes(spark, path).collect()}
    if told != found:
        raise ValueError(f"{path}: the recipes differ from the manifest")


def _open(payload: bytes, n: int, name: bytes) -> bytes:
    raw = np.ascontiguousarray(np.frombuffer(unsqueeze(payload), np.uint8).reshape(4, n).T).tobytes() if n else b""
    if hashlib.blake2b(raw, digest_size=16).digest() != bytes(name):
        raise ValueError("a chunk differs from its name")
    return raw


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of every document, rebuilt from recipes and chunks."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            ids = [np.concatenate([np.frombuffer(_open(c["payload"], c["n"], c["chunk"]), "<u4") for c in cs]).astype(np.int64) for cs in df["cs"]]
            yield pd.DataFrame({"doc_id": df["doc_id"], "start": df["start"], "ids": ids})

    verify(spark, path)
    packed = spark.read.parquet(f"{path}/packs").where("payload is not null").select("chunk", "n", "payload")
    r = spark.read.parquet(f"{path}/recipes").select("uid", "doc_id", "start", F.posexplode("chunks").alias("seq", "chunk"))
    r = r.join(packed, "chunk").groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sort_array(F.collect_list(F.struct("seq", "chunk", "n", "payload"))).alias("cs"))
    return r.select("doc_id", "start", "cs").mapInPandas(build, "doc_id long, start long, ids array<long>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: each stored chunk is opened, checked and
    summed once where it lies, and a document's sum is put together from those of its chunks."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [_open(p, n, c) for p, n, c in zip(b.column("payload").to_pylist(), b.column("n").to_pylist(), b.column("chunk").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(map(len, raw), pa.int64()), pa.array(map(zlib.crc32, raw), pa.int64())], names=["chunk", "size", "crc"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cs")
            flat = lists.flatten()
            size, crc = [flat.field(k).to_numpy(zero_copy_only=False) for k in ("size", "crc")]
            count = np.diff(lists.offsets.to_numpy())
            first, total, whole = np.cumsum(count) - count, np.zeros(len(count), np.uint64), np.zeros(len(count), np.int64)
            who = np.argsort(-count, kind="stable")
            for k in range(int(count.max(initial=0))):
                who = who[: int(np.searchsorted(-count[who], -k, side="left"))]  # documents of more than k chunks
                at = first[who] + k
                total[who] = crc_join(total[who], crc[at], size[at])
                whole[who] += size[at]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(whole // 4), pa.array(total.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    verify(spark, path)
    packed = spark.read.parquet(f"{path}/packs").where("payload is not null").select("chunk", "n", "payload").mapInArrow(sums, "chunk binary, size long, crc long")
    r = spark.read.parquet(f"{path}/recipes").select("uid", "doc_id", "start", F.posexplode("chunks").alias("seq", "chunk"))
    r = r.join(packed, "chunk").groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sort_array(F.collect_list(F.struct("seq", "size", "crc"))).alias("cs"))
    return r.select("doc_id", "start", "cs").mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")
