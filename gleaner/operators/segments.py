"""Texts cut into units: by headings, blank lines and size, long ones again at sentences with an overlap."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters after which a list item starts a unit, a unit ends, a unit is cut, and what two pieces share.
LIST_CHARS, UNIT_CHARS, LONG_CHARS, OVERLAP = 500, 1200, 1600, 180
# A heading's most characters and words; patterns of words, numbers, numbered headings, list items, sentence ends.
HEADING_CHARS, HEADING_WORDS = 140, 18
WORD = re.compile(r"[A-Za-z][A-Za-z&/+.-]*")
NUMERIC = re.compile(r"[\d\s./:%-]+")
NUMBERED = re.compile(r"^\d+(?:\.\d+)*[.)]?\s+\S")
LIST_ITEM = re.compile(r"^\s*(?:[-*]|\d+[.)])\s+\S")
SENTENCE_END = re.compile(r"[.?!] ")


def is_heading(line: str) -> bool:
    """Whether a line without outer blanks reads as a heading: marked, numbered, in capitals or in title case."""
    if not 0 < len(line) <= HEADING_CHARS or "http://" in line or "https://" in line or NUMERIC.fullmatch(line):
        return False
    words = WORD.findall(line)
    if not 0 < len(words) <= HEADING_WORDS or sum(map(str.isdigit, line)) > max(3, len(line) // 5):
        return False
    if line[0] == "#" or NUMBERED.match(line) or (len(words) > 1 and line.isupper()):
        return True
    return line[-1] not in ".?!;" and sum(w[0].isupper() for w in words) >= max(1, len(words) - 1)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once, however often use names it; an expression named twice is evaluated (and planned) twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def reads_as_heading(line: Column) -> Column:
    """is_heading() as an expression, for lines without outer blanks."""
    digits = F.length(F.regexp_replace(line, "[^0-9]", ""))
    plain = F.length(line).between(1, HEADING_CHARS) & ~line.rlike("https?://") & ~line.rlike(f"^{NUMERIC.pattern}$")
    marked, shouted, ended = line.startswith("#") | line.rlike(NUMBERED.pattern), F.upper(line) == line, line.rlike("[.?!;]$")

    def fits(words: Column) -> Column:
        titled = ~ended & (F.size(F.filter(words, lambda w: w.rlike("^[A-Z]"))) >= F.greatest(F.lit(1), F.size(words) - 1))
        return F.size(words).between(1, HEADING_WORDS) & (digits <= F.greatest(F.lit(3), F.floor(F.length(line) / 5))) & (marked | (shouted & (F.size(words) > 1)) | titled)

    # most prose ends as a sentence, and its words need not be told apart
    may = plain & (~ended | shouted | marked)
    return F.coalesce(may & let(F.regexp_extract_all(line, F.lit(WORD.pattern), F.lit(0)), fits), F.lit(False))


def pieces(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of a long unit's pieces.  A piece ends behind its last sentence end, else at its last space,
    unless that leaves less than half of the most it may hold."""
    stops, spaces = [m.start() for m in SENTENCE_END.finditer(text)], [m.start() for m in re.finditer(" ", text)]
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + LONG_CHARS)
        if end < len(text):
            for places, width, taken in ((stops, 2, 1), (spaces, 1, 0)):
                k = bisect_left(places, end - width + 1)
                if k and places[k - 1] >= at + LONG_CHARS // 2:
                    end = places[k - 1] + taken
                    break
        if part := text[at:end].strip():
            out.append((at, end, part))
        if end == len(text):
            break
        at = max(at + 1, end - OVERLAP)
    return out


def stretches(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """(first, last, heading): line numbers from 1 of each unit, and the heading above it (its own line, if it starts with one)."""
    first, size, heading = 0, 0, ""
    for i, line in enumerate(lines, 1):
        bare = line.strip()
        head = is_heading(bare)
        if first and (head or not bare or (size > LIST_CHARS and LIST_ITEM.match(line))):
            yield first, i - 1, heading
            first = 0
        if not bare:
            continue
        first, size = (first, size + 1 + len(line)) if first else (i, len(line))
        if head:
            heading = bare
        elif size > UNIT_CHARS:
            yield first, i, heading
            first = 0
    if first:
        yield first, len(lines), heading


def cut(text: str, page: int | None = None) -> list[tuple[str, str, str]]:
    """(anchor, text, heading) of every unit; anchors name the page, the lines and, in a long unit, the characters."""
    lines, mark, out = text.splitlines(), "" if page is None else f"p{page}:", []
    for first, last, heading in stretches(lines):
        body, anchor = "\n".join(lines[first - 1 : last]).strip(), f"{mark}L{first}-L{last}"
        if len(body) <= LONG_CHARS:
            out.append((anchor, body, heading))
        else:
            out += [(f"{anchor}:C{a}-{b}", part, heading) for a, b, part in pieces(body)]
    return out


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", page_col: str | None = None) -> DataFrame:
    """id, idx (from 0), anchor, text, heading of the units of every text; a null or blank text has none."""
    page = docs[page_col].cast("int") if page_col else F.lit(None).cast("int")
    src = docs.where(docs[text_col].isNotNull()).select(docs[id_col].alias("id"), page.alias("page"), docs[text_col].alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(i, k, *unit) for i, p, t in zip(df["id"], df["page"], df["text"], strict=True) for k, unit in enumerate(cut(t, None if pd.isna(p) else int(p)))]
            yield pd.DataFrame(rows, columns=["id", "idx", "anchor", "text", "heading"])

    schema = f"id {src.schema['id'].dataType.simpleString()}, idx int, anchor string, text string, heading string"
    return src.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def skeleton(units: DataFrame, id_col: str = "doc_id", most: int | None = None) -> DataFrame:
    """id, headings: each document's headings in the order of their first units, equal ones once; the first `most`, if given."""
    firsts = units.where("heading <> ''").groupBy(id_col, "heading").agg(F.min("idx").alias("idx"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("idx", "heading"))), lambda x: x["heading"])
    return firsts.groupBy(id_col).agg((F.slice(names, 1, most) if most else names).alias("headings"))
