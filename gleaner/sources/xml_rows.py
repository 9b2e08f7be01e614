"""XML texts as rows, an element each, without a tree: a stack of open elements and the parser's events.

Defined cases: a null text gives no rows; a text that is no XML, or is cut, gives the elements before the fault and a last row with
`error` and no tag; blanks inside a text are single spaces; what stands in an element after its first child is not its text;
names keep their prefixes; repeated ids give rows of their own; an empty table gives no rows.  A text is one value in one task,
and is parsed in pieces, so beside it only the open elements are held.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE, ROWS = 1 << 16, 4_096
FIELDS = [("idx", pa.int64()), ("path", pa.string()), ("tag", pa.string()), ("depth", pa.int64()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("error", pa.string())]


def events(text: str) -> Iterator[tuple]:
    """(idx, path, tag, depth, attributes, text, error) of every element, in the order in which they begin."""
    done: list[tuple] = []
    stack: list[str] = []
    waiting: list = []  # the element whose text may still come, if no child has begun
    parser, n = expat.ParserCreate(), 0

    def flush() -> None:
        nonlocal n
        if waiting:
            path, tag, depth, attributes, said = waiting.pop()
            done.append((n, path, tag, depth, attributes, " ".join("".join(said).split()), None))
            n += 1

    def opened(tag: str, attributes: dict[str, str]) -> None:
        flush()
        stack.append(tag)
        waiting.append(("/" + "/".join(stack), tag, len(stack), list(attributes.items()), []))

    def closed(tag: str) -> None:
        flush()
        stack.pop()

    def said(data: str) -> None:
        if waiting:
            waiting[0][4].append(data)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = opened, closed, said
    try:
        for at in range(0, len(text) + 1, PIECE):
            parser.Parse(text[at : at + PIECE], at + PIECE > len(text))
            yield from done
            done.clear()
    except expat.ExpatError as fault:
        flush()
        yield from done
        yield n, None, None, None, None, None, expat.ErrorString(fault.code)


def elements(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """id, idx, path, tag, depth, attributes, text, error: a row for each element of each text."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            ids: list[int] = []

            def batch() -> pa.RecordBatch:
                arrays = [b.column(0).take(pa.array(ids, pa.int64())), *[pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(FIELDS)]]
                return pa.RecordBatch.from_arrays(arrays, names=[id_col, *[n for n, _ in FIELDS]])

            for k, text in enumerate(b.column(1).to_pylist()):
                for row in events(text) if text is not None else ():
                    ids.append(k)
                    out.append(row)
                    if len(out) >= ROWS:
                        yield batch()
                        out, ids = [], []
            yield batch()

    return docs.select(id_col, xml_col).mapInArrow(run, f"{id_col} {kind}, idx long, path string, tag string, depth long, attributes map<string, string>, text string, error string")


def profile(found: DataFrame, id_col: str) -> DataFrame:
    """id, root, child_counts (a map by tag), root_attributes, n_elements, max_depth, error of each text."""
    first = F.col("depth") == 1
    children = found.where("depth = 2").groupBy(id_col, "tag").agg(F.count("*").alias("n")).groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("child_counts"))
    whole = found.groupBy(id_col).agg(F.max(F.when(first, F.col("tag"))).alias("root"), F.max(F.when(first, F.array_sort(F.map_keys("attributes")))).alias("root_attributes"), F.count("tag").alias("n_elements"), F.max("depth").alias("max_depth"), F.max("error").alias("error"))
    return whole.join(children, id_col, "left").select(id_col, "root", "child_counts", "root_attributes", "n_elements", "max_depth", "error")


def rendered(orders: DataFrame) -> DataFrame:
    """doc_id, xml: a text for each customer with an element for each order."""
    order = F.concat(F.lit('<order key="'), F.col("o_orderkey").cast("string"), F.lit('" kind="&lt;x&gt;">\n <status>'), F.col("o_orderstatus"), F.lit("</status> <note>a  b &amp;\n c</note></order>"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", order.alias("x")))), lambda o: o["x"])
    return orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit('<?xml version="1.0"?><customer id="'), F.first("o_custkey").cast("string"), F.lit('">'), F.array_join(listed, "\n"), F.lit("</customer>")).alias("xml"))
