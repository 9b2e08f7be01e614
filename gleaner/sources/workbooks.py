"""XLSX workbooks by their ZIP parts: a row for each sheet, then a row for each line of cells, without a workbook library.

A workbook's parts are taken apart once: each sheet becomes a row of its own with its part and the shared strings that it uses, so
sheets are read by different tasks, and sheets and columns that are not asked for are not parsed.  Cells come from the
parser's events; no tree of a sheet is held.

Defined cases: a null workbook gives no sheets; what is no ZIP archive, or whose part is broken, gives a row with `error`; sheets are
numbered by their part's number, a sheet without a name in the workbook's list is Sheet<n>; missing cells of a line are empty
texts; lines of empty cells are left out, but counted in their number; a formula's cell gives its stored value.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SHEET = re.compile(r"xl/worksheets/sheet(\d+)\.xml")
LINES = 2_048


def column_number(ref: str) -> int | None:
    """0 for A1, 27 for AB3; none without letters."""
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1 if n else None


def strings(xml: bytes) -> list[str]:
    """The texts of the shared strings' items."""
    out: list[list[str]] = []
    inside = False
    parser = expat.ParserCreate()

    def opened(tag: str, _: dict) -> None:
        nonlocal inside
        if tag.rpartition(":")[2] == "si":
            out.append([])
        inside = tag.rpartition(":")[2] == "t"

    def closed(tag: str) -> None:
        nonlocal inside
        inside = False

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = opened, closed, lambda s: inside and out and out[-1].append(s)
    parser.Parse(xml, True)
    return ["".join(x) for x in out]


def sheet_names(xml: bytes) -> list[str]:
    names: list[str] = []
    parser = expat.ParserCreate()
    parser.StartElementHandler = lambda tag, a: names.append(a.get("name", "")) if tag.rpartition(":")[2] == "sheet" else None
    parser.Parse(xml, True)
    return names


def lines(xml: bytes, shared: Sequence[str], columns: set[int] | None = None) -> Iterator[tuple[int, list[str]]]:
    """(number, cells) of a sheet's lines that hold something; of the asked columns only."""
    done: list[tuple[int, list[str]]] = []
    line: dict[int, str] = {}
    number = at = 0
    kind, said, taking = "", [], False
    parser = expat.ParserCreate()

    def opened(tag: str, a: dict[str, str]) -> None:
        nonlocal number, at, kind, taking
        tag = tag.rpartition(":")[2]
        if tag == "row":
            line.clear()
            number, at = int(a.get("r", number + 1)), 0
        elif tag == "c":
            place = column_number(a.get("r", ""))
            at, kind = at if place is None else place, a.get("t", "")
            said.clear()
        taking = (tag == "v" or (tag == "t" and kind == "inlineStr")) and (columns is None or at in columns)

    def closed(tag: str) -> None:
        nonlocal at, taking
        tag, taking = tag.rpartition(":")[2], False
        if tag == "c":
            value = "".join(said)
            if kind == "s" and value.isdigit() and int(value) < len(shared):
                value = shared[int(value)]
            if value:
                line[at] = value
            at += 1
        elif tag == "row" and line:
            done.append((number, [line.get(k, "") for k in range(max(line) + 1)]))

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = opened, closed, lambda s: said.append(s) if taking else None
    for start in range(0, len(xml) + 1, 1 << 16):
        try:
            parser.Parse(xml[start : start + (1 << 16)], start + (1 << 16) > len(xml))
        except expat.ExpatError:  # the lines before the fault are whole
            yield from done
            raise
        yield from done
        done.clear()


def sheets(books: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """id, place, sheet, part, strings, error: a row for each sheet of each workbook, its XML and the workbook's shared strings."""
    kind = dict(books.dtypes)[id_col]

    def apart(content: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = set(z.namelist())
                titles = sheet_names(z.read("xl/workbook.xml")) if "xl/workbook.xml" in names else []
                shared = z.read("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in names else None
                found = sorted((int(m[1]), n) for n in names if (m := SHEET.fullmatch(n)))
                for k, (_, name) in enumerate(found):
                    yield k + 1, titles[k] if k < len(titles) and titles[k] else f"Sheet{k + 1}", z.read(name), shared, None
        except (zipfile.BadZipFile, expat.ExpatError, KeyError) as fault:
            yield 0, None, None, None, str(fault)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.string()]
        for b in batches:
            for k, content in enumerate(b.column(1).to_pylist()):
                rows = list(apart(content)) if content is not None else []
                ids = b.column(0).take(pa.array([k] * len(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]], names=[id_col, "place", "sheet", "part", "strings", "error"])

    return books.select(id_col, content_col).mapInArrow(run, f"{id_col} {kind}, place long, sheet string, part binary, strings binary, error string")


def relevant(found: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Sheets whose name holds one of the terms; all of a workbook's where none does or none is given."""
    if not terms:
        return found
    hit = F.lower("sheet").rlike("|".join(re.escape(t.lower()) for t in terms))
    named = found.where(hit).select(found.columns[0]).distinct().withColumn("_named", F.lit(True))
    return found.join(named, found.columns[0], "left").where(hit | F.col("_named").isNull()).drop("_named")


def cells(found: DataFrame, columns: Sequence[int] | None = None) -> DataFrame:
    """id, place, sheet, line, cells, error of sheets(): a row for each line that holds something.  columns: the ones to read (from 0)."""
    id_col = found.columns[0]
    kind, wanted = dict(found.dtypes)[id_col], None if columns is None else set(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (part, shared, error) in enumerate(zip(*[b.column(c).to_pylist() for c in ("part", "strings", "error")], strict=True)):
                out: list[tuple] = [(None, None, error)] if error else []

                def batch() -> pa.RecordBatch:
                    same = pa.array([k] * len(out), pa.int64())
                    kinds = [pa.int64(), pa.list_(pa.string()), pa.string()]
                    return pa.RecordBatch.from_arrays([*[b.column(c).take(same) for c in (id_col, "place", "sheet")], *[pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)]], names=[id_col, "place", "sheet", "line", "cells", "error"])

                try:
                    for number, values in lines(part, strings(shared) if shared else [], wanted) if part else ():
                        out.append((number, values, None))
                        if len(out) >= LINES:
                            yield batch()
                            out = []
                except expat.ExpatError as fault:
                    out.append((None, None, str(fault)))
                yield batch()

    return found.repartition(id_col, "place").mapInArrow(run, f"{id_col} {kind}, place long, sheet string, line long, cells array<string>, error string")


def profile(read: DataFrame) -> DataFrame:
    """id, place, sheet, headers (the first line's cells), n_rows, n_columns, samples (the first two lines below) of each sheet."""
    by = read.columns[:3]
    first = F.min(F.struct("line", "cells"))["cells"]
    below = F.slice(F.array_sort(F.collect_list(F.when(F.col("place_in") <= 3, F.struct("line", "cells")))), 2, 2)
    placed = read.where("cells is not null").withColumn("place_in", F.row_number().over(W.partitionBy(*by).orderBy("line")))
    return placed.groupBy(*by).agg(first.alias("headers"), F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("n_columns"), F.transform(below, lambda x: x["cells"]).alias("samples"))


def book(named: dict[str, list[list[object]]]) -> bytes:
    """A workbook of the given sheets: texts of the first column inline, other texts shared, numbers as they are."""
    shared: dict[str, int] = {}

    def cell(value: object, line: int, column: int) -> str:
        ref = f'r="{chr(65 + column)}{line}"'
        if value is None:
            return ""
        if not isinstance(value, str):
            return f"<c {ref}><v>{value}</v></c>"
        if column == 0:
            return f'<c {ref} t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        return f'<c {ref} t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'

    space, out = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, rows in enumerate(named.values(), 1):
            body = "".join(f'<row r="{i}">{"".join(cell(v, i, c) for c, v in enumerate(row))}</row>' for i, row in enumerate(rows, 1))
            z.writestr(zipfile.ZipInfo(f"xl/worksheets/sheet{k}.xml"), f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
        z.writestr(zipfile.ZipInfo("xl/workbook.xml"), f"<workbook {space}><sheets>{''.join(f'<sheet name={quoteattr(n)}/>' for n in named)}</sheets></workbook>")
        z.writestr(zipfile.ZipInfo("xl/sharedStrings.xml"), f"<sst {space}>{''.join(f'<si><t>{escape(s)}</t></si>' for s in shared)}</sst>")
    return out.getvalue()


def rendered(part: DataFrame, size: int = 250) -> DataFrame:
    """book, content: a workbook for every `size` part keys, with a sheet of names and one of sizes."""

    def make(df: pd.DataFrame) -> pd.DataFrame:
        rows = df.sort_values("p_partkey")[["p_brand", "p_name", "p_partkey", "p_size"]].values.tolist()
        named = {"Names & brands": [["brand", "name", "key"], *[[b, n, int(k)] for b, n, k, _ in rows]], "sizes": [["brand", None, "size"], *[[b, None, int(z)] for b, _, _, z in rows]]}
        return pd.DataFrame({"book": [int(df["book"].iloc[0])], "content": [book(named)]})

    keyed = part.select(F.floor(F.col("p_partkey") / size).alias("book"), "p_partkey", "p_name", "p_brand", "p_size")
    return keyed.groupBy("book").applyInPandas(make, "book long, content binary")
