"""Items of collections (mail headers and snippets) and key paths of JSON and YAML texts."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

# Characters of a snippet, keys and columns that one names, lines of a table it samples; a header line.
SNIPPET_CHARS, SNIPPET_KEYS, SNIPPET_COLUMNS, SAMPLE_LINES = 260, 16, 20, 6
HEADER = re.compile(r"^(From|To|Date|Subject):\s*(.+)$", re.IGNORECASE)
#: Entries of a list that become paths, in a file of its own and in a collection.
LIST_ENTRIES, ITEM_ENTRIES = 200, 40


def parsed(text: str, kind: str) -> Any:
    import yaml

    return json.loads(text) if kind == "json" else yaml.safe_load(text)


def outline(text: str, kind: str) -> str:
    """What a structured text holds: its top keys, or a table's columns; empty for other kinds and for broken texts."""
    try:
        if kind == "csv":
            rows = list(csv.reader(text.splitlines()[:SAMPLE_LINES]))
            return f"columns: {', '.join(rows[0][:SNIPPET_COLUMNS])}; sample_rows: {len(rows) - 1}" if rows else ""
        data = parsed(text, kind) if kind in ("json", "yaml") else None
    except Exception:  # a text that does not parse has no outline, whatever the parser says
        return ""
    keys = lambda x: ", ".join(map(str, list(x)[:SNIPPET_KEYS]))
    if isinstance(data, dict):
        return f"top_keys: {keys(data)}"
    if isinstance(data, list):
        return f"list_len: {len(data)}" + (f"; item_keys: {keys(data[0])}" if data and isinstance(data[0], dict) else "")
    return ""


def item(text: str, kind: str) -> tuple[str, str, str, str]:
    """Subject, sender, date and snippet: headers stand before the first blank line, the rest is the body."""
    lines = text.replace("\r\n", "\n").splitlines()
    top = next((i for i, x in enumerate(lines) if not x.strip()), len(lines))
    heads = [HEADER.match(x) for x in lines[:top]]
    named = {m[1].lower(): m[2].strip() for m in heads if m}
    body = [x.strip() for x, m in zip(lines[:top], heads, strict=True) if not m] + [x.strip() for x in lines[top + 1 :]]
    joined = lambda xs: " ".join(x for x in xs if x)[:SNIPPET_CHARS]
    snippet = outline(text, kind) or joined(body) or joined(x.strip() for x in lines)
    return named.get("subject", ""), named.get("from", ""), named.get("date", ""), snippet


def items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "text") -> DataFrame:
    """id, subject, sender, date, snippet of every text.  A null text is empty."""
    src = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            found = zip(*(item(t, kind) for t in b.column("t").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x, pa.string()) for x in found)], names=["id", "subject", "sender", "date", "snippet"])

    schema = f"id {src.schema['id'].dataType.simpleString()}, subject string, sender string, date string, snippet string"
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def leaves(data: Any, most: int = LIST_ENTRIES, whole_lists: bool = False, at: str = "$") -> Iterator[tuple[str, str]]:
    """(path, value) of every scalar.  A list gives its first `most` entries, and its length if it is longer;
    whole_lists: a list of scalars alone is one value, as JSON."""
    todo = [(at, data)]
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{path}.{k}", v) for k, v in reversed(x.items())]
        elif isinstance(x, list) and whole_lists and not any(isinstance(v, (dict, list)) for v in x):
            yield path, json.dumps(x, ensure_ascii=False)
        elif isinstance(x, list):
            if len(x) > most:
                todo.append((f"{path}.length", str(len(x))))
            todo += [(f"{path}[{i}]", x[i]) for i in range(min(len(x), most) - 1, -1, -1)]
        else:
            yield path, "" if x is None else str(x)


def key_paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "json", whole_lists: bool = False) -> DataFrame:
    """id, idx (from 0), path, value of the scalars of every JSON or YAML text; null and broken texts have none."""
    most = ITEM_ENTRIES if whole_lists else LIST_ENTRIES
    src = docs.where(docs[text_col].isNotNull()).select(docs[id_col].alias("id"), docs[text_col].alias("t"))

    def found(text: str) -> list[tuple[str, str]]:
        import yaml

        try:
            return list(leaves(parsed(text, kind), most, whole_lists))
        except (ValueError, RecursionError, yaml.YAMLError):
            return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(i, k, *leaf) for i, t in zip(df["id"], df["t"], strict=True) for k, leaf in enumerate(found(t))]
            yield pd.DataFrame(rows, columns=["id", "idx", "path", "value"])

    schema = f"id {src.schema['id'].dataType.simpleString()}, idx int, path string, value string"
    return src.mapInPandas(run, schema).withColumnRenamed("id", id_col)
