"""Byte-level BPE encoding and decoding with DuckDB's recursive queries (operator 9).

Each task splits its texts by the tokenizer's pattern and hands the words it has not met yet to an in-process
DuckDB.  There a word is a set of rows (word, byte position, token); a recursive query joins neighbouring rows
with the merge table, contracts each word's leftmost pair of least rank and repeats until no pair is left.
Equal pairs of one word that do not overlap are contracted in one round where that cannot change the result: where no
merge with the new token has a lower rank than the token itself.  A word of any length takes this way; the recursion is cut
after as many rounds as its rows may fill, and goes on from where it was.  An ordered aggregation over each document's ids,
joined with the vocabulary, decodes them, and a document whose ids do not give back its words ends the job.

Met words are kept as 64-bit hashes and places in one pool of ids.  Two words of one hash would be told by the decoding.

Defined cases: a null text is an empty one (no ids, no bytes); a row with a null id is kept; repeated rows give
one result row each; extra columns are not read, so their names cannot clash; a very long text is a block of its own; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
from collections.abc import Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .kernel import give_back, places, span_hashes

#: Words contracted at once, rows that a recursion may hold, words kept, characters of texts in a block, ids decoded at once.
WORDS_AT_ONCE, MOST_ROWS, CACHE_WORDS, BLOCK_CHARS, IDS_AT_ONCE = 20_000, 2_000_000, 1_000_000, 1_000_000, 250_000

#: chain: places of equal pairs that overlap; every second one of such a run is taken, from the left.
ENCODE = """
WITH RECURSIVE t(w, p, e, tok, it) AS (
  SELECT w, p, e, tok, 0 FROM start_rows
  UNION ALL (
    WITH pairs AS MATERIALIZED (
      SELECT a.w, a.p, n.p AS np, n.e AS ne, m, alone FROM t a JOIN t n ON n.p = a.e AND n.w = a.w JOIN merges ON k = a.tok * 65536 + n.tok),
    best AS (SELECT w, min(m) AS m FROM pairs GROUP BY w),
    hits AS (SELECT w, p, np, ne, m, alone, lag(np) OVER (PARTITION BY w ORDER BY p) AS before, row_number() OVER (PARTITION BY w ORDER BY p) AS r
             FROM pairs SEMI JOIN best USING (w, m)),
    chained AS (SELECT *, max(CASE WHEN before IS NULL OR before <> p THEN r END) OVER (PARTITION BY w ORDER BY r) AS head FROM hits),
    done AS MATERIALIZED (SELECT w, p, np, ne, m FROM chained WHERE CASE WHEN alone THEN r = 1 ELSE (r - head) % 2 = 0 END)
    SELECT t.w, t.p, coalesce(done.ne, t.e), coalesce(done.m, t.tok), it + 1
    FROM t SEMI JOIN best USING (w) LEFT JOIN done ON t.p = done.p WHERE t.p NOT IN (SELECT np FROM done) AND it < $most))
SELECT w, tok, it FROM t SEMI JOIN (SELECT w, max(it) AS it FROM t GROUP BY w) USING (w, it) ORDER BY p"""
DECODE = "SELECT d, array_to_string(list(piece ORDER BY p), '') AS piece FROM id_rows JOIN vocabulary ON tok = id GROUP BY d"


class Coder:
    """The vocabulary of one rank file in a DuckDB of its own, with the words met so far."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(self.ranks.values(), default=0) >= 65536:
            raise ValueError("ranks must be below 65536")
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        keys, merged, early = [], [], set()
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * 65536 + b)
                    merged.append(r)
                    early.update(x for x in (a, b) if x > r)
        ids = sorted(self.ranks.values())
        of = {r: t for t, r in self.ranks.items()}
        # a byte of a token is the character of that number
        self.tables = {
            "merges": pa.table({"k": pa.array(keys, pa.int64()), "m": pa.array(merged, pa.int64()), "alone": [r in early for r in merged]}),
            "vocabulary": pa.table({"id": pa.array(ids, pa.int32()), "piece": [of[r].decode("latin-1") for r in ids]}),
        }
        self.open_db: duckdb.DuckDBPyConnection | None = None
        self.ids, self.decimals = np.array(ids), pa.array([str(r) for r in range(max(ids) + 1)])
        self.clear()

    @property
    def db(self) -> duckdb.DuckDBPyConnection:
        if self.open_db is None:
            self.open_db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": "", "allocator_flush_threshold": "32MB"})
            for name, table in self.tables.items():
                self.open_db.register("rows_of_it", table)
                self.open_db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_of_it")
                self.open_db.unregister("rows_of_it")
        return self.open_db

    def rest(self) -> None:
        if self.open_db is not None:
            self.open_db.close()
            self.open_db = None
        give_back()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint16)

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        whole = [self.ranks.get(x) for x in words]
        left = [i for i, r in enumerate(whole) if r is None and words[i]]
        size = np.array([0 if r is None else 1 for r in whole], np.int64)
        parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for at in range(0, len(left), WORDS_AT_ONCE):
            some = np.array(left[at : at + WORDS_AT_ONCE])
            data = np.frombuffer(b"".join(words[i] for i in some), np.uint8)
            n = np.array([len(words[i]) for i in some])
            w, tok = self._contracted(np.repeat(some, n), self.single[data])
            count = np.bincount(np.searchsorted(some, w), minlength=len(some))
            parts[at] = some, count, tok
            size[some] = count
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint16)
        alone = [i for i, r in enumerate(whole) if r is not None]
        out[first[alone]] = [whole[i] for i in alone]
        for some, count, tok in parts.values():
            out[places(first[some], count)] = tok
        return out, size

    def _contracted(self, w: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (word, token), in order, after the last contraction; w: ascending."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(w):
            p = np.arange(len(w))
            self.db.register("start_rows", pa.table({"w": pa.array(w, pa.int32()), "p": pa.array(p, pa.int32()), "e": pa.array(p + 1, pa.int32()), "tok": pa.array(tok, pa.int64())}))
            most = max(1, MOST_ROWS // len(w))
            got = self.db.execute(ENCODE, {"most": most}).fetchnumpy()
            on = got["it"] == most
            done.append((got["w"][~on], got["tok"][~on]))
            w, tok = got["w"][on], got["tok"][on]
        words, tokens = [np.concatenate(x) for x in zip(*done, strict=True)]
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def learn(self, names: np.ndarray, words: list[bytes]) -> None:
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        ids, size = self.contract(words)
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, ids])
        keys = np.concatenate([self.keys, names])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size.astype(np.int32)])[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
        """The ids of all texts and where each one's start; the bytes of their words and where each text's start."""
        split = self.pattern.findall
        pieces = [split(t) for t in texts]
        count = np.array([len(p) for p in pieces], np.int64)
        flat = list(chain.from_iterable(pieces))
        del pieces
        chars = np.fromiter(map(len, flat), np.int64, len(flat))
        raw = "".join(flat).encode()
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(chars)
        del flat
        if len(data) != (ends[-1] if len(ends) else 0):  # not ASCII: from characters to bytes
            ends = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[ends]
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        h = span_hashes(data, begins, ends)
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        while True:
            k = np.minimum(np.searchsorted(self.keys, u), max(0, len(self.keys) - 1))
            miss = self.keys[k] != u if len(self.keys) else np.ones(len(u), bool)
            if not miss.any():
                break
            full = len(self.keys) > CACHE_WORDS  # then all are learnt anew
            who = first if full else first[miss]
            self.learn(u if full else u[miss], [raw[a:b] for a, b in zip(begins[who].tolist(), ends[who].tolist(), strict=True)])
        size = self.size[k][back].astype(np.int64)
        ids = self.pool[places(self.at[k][back], size)]
        starts = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
        return ids, starts, raw, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The bytes of each stretch of ids."""
        if len(bad := np.setdiff1d(ids, self.ids)):
            raise ValueError(f"no token has the id {bad[0]}")
        out, at = [b""] * (len(starts) - 1), 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + IDS_AT_ONCE, side="right")) - 1)
            n = np.diff(starts[at : to + 1])
            part = ids[starts[at] : starts[to]]
            self.db.register("id_rows", pa.table({"d": pa.array(np.repeat(np.arange(at, to), n), pa.int32()), "p": pa.array(np.arange(len(part)), pa.int32()), "tok": pa.array(part, pa.int32())}))
            got = self.db.execute(DECODE).fetchnumpy()
            for d, piece in zip(got["d"].tolist(), got["piece"], strict=True):
                out[d] = piece.encode("latin-1")
            at = to
        return out


_coders: dict[tuple[str, str], Coder] = {}


@contextlib.contextmanager
def coder(path: str, pattern: str) -> Iterator[Coder]:
    """A coder for one task.  Between a worker's tasks only the words met are kept, as workers live on beside others."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    c = _coders[path, pattern]
    try:
        yield c
    finally:
        c.rest()


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Where each block of texts starts, and the texts (null: empty)."""
    block, size, at = [], 0, 0
    for i in range(len(column)):
        block.append(column[i].as_py() or "")
        size += len(block[-1])
        if size >= BLOCK_CHARS:
            yield at, block
            block, size, at = [], 0, i + 1
    if block:
        yield at, block


DIGEST = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, held: bool = False) -> DataFrame:
    """One row per row of docs: the id and ids array<int>; with digest, n_tokens, ids_sha256 and decoded_sha256
    (of the ids' decoded bytes) instead of ids.  `ranks` is the place of the rank file on every machine.
    Every row's ids are decoded and held against its words, with held also against its text; a difference ends the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coder(ranks, pattern) as c:
            for batch in batches:
                yield from coded(c, batch)
                give_back()

    def coded(c: Coder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, texts in _blocks(batch.column("text")):
            names = batch.column("id").slice(at, len(texts))
            ids, starts, raw, cuts = c.encode(texts)
            back = c.decode(ids, starts)
            for i, x in enumerate(back):
                if x != raw[cuts[i] : cuts[i + 1]] or held and x != texts[i].encode():
                    raise ValueError(f"the ids of document {names[i]} do not decode to its text")
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            if digest:
                joined = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, c.decimals.take(lists.values)), ",")
                sums = [hashlib.sha256(joined[i].as_buffer() or b"").hexdigest() for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([names, pa.array(np.diff(starts)), pa.array(sums), pa.array([hashlib.sha256(x).hexdigest() for x in back])], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([names, lists], names=["id", "ids"])

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return src.mapInArrow(run, DIGEST if digest else "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and the decoded bytes of every row of ids (null ids: no bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with coder(ranks, pattern) as c:
            for b in batches:
                lists = b.column("ids")
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(c.decode(lists.flatten().to_numpy(zero_copy_only=False), starts), pa.binary())], names=["id", "bytes"])

    src = encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].cast("array<int>").alias("ids"))
    return src.mapInArrow(run, "id long, bytes binary").withColumnRenamed("id", id_col)
