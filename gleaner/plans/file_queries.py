"""Queries over XML, workbooks and JSON rendered from tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketch
from ..sources import tables, workbooks, xml_rows
from .registry import query

ORDER = "o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS j FROM orders)"


def _xml(s, d):
    return xml_rows.elements(xml_rows.rendered(tables.table(s, d, "orders")), "doc_id", "xml")


@query(f"""WITH {ORDER} SELECT o_custkey AS doc_id, 0 AS idx, '/customer' AS path, 1 AS depth, 'id=' || o_custkey AS attributes, '' AS text FROM o WHERE j = 0
UNION ALL SELECT o_custkey, 1 + 3 * j, '/customer/order', 2, 'key=' || o_orderkey || ' kind=<x>', '' FROM o
UNION ALL SELECT o_custkey, 2 + 3 * j, '/customer/order/status', 3, '', o_orderstatus FROM o UNION ALL SELECT o_custkey, 3 + 3 * j, '/customer/order/note', 3, '', 'a b & c' FROM o""")
def xml_elements(s, d):
    said = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    return _xml(s, d).select("doc_id", "idx", "path", "depth", said.alias("attributes"), "text")


@query("SELECT o_custkey AS doc_id, 'customer' AS root, 'order=' || count(*) AS children, 'id' AS root_attributes, 1 + 3 * count(*) AS n_elements, 3 AS max_depth FROM orders GROUP BY o_custkey")
def xml_profiles(s, d):
    got = xml_rows.profile(_xml(s, d), "doc_id")
    children = F.array_join(F.transform(F.map_entries("child_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), " ")
    return got.select("doc_id", "root", children.alias("children"), F.array_join("root_attributes", " ").alias("root_attributes"), "n_elements", "max_depth")


BOOKS = "b AS (SELECT *, p_partkey // 250 AS book, row_number() OVER (PARTITION BY p_partkey // 250 ORDER BY p_partkey) AS j FROM part)"


def _books(s, d):
    return workbooks.sheets(workbooks.rendered(tables.table(s, d, "part")), "book", "content")


@query(f"""WITH {BOOKS} SELECT book, 1 AS place, 'Names & brands' AS sheet, 1 + j AS line, p_brand || '|' || p_name || '|' || p_partkey AS cells FROM b UNION ALL SELECT DISTINCT book, 1, 'Names & brands', 1, 'brand|name|key' FROM b
UNION ALL SELECT book, 2, 'sizes', 1 + j, p_brand || '||' || p_size FROM b UNION ALL SELECT DISTINCT book, 2, 'sizes', 1, 'brand||size' FROM b""")
def workbook_lines(s, d):
    return workbooks.cells(_books(s, d)).select("book", "place", "sheet", "line", F.array_join("cells", "|").alias("cells"))


@query(f"WITH {BOOKS} SELECT book, 'sizes' AS sheet, '||size' AS headers, count(*) + 1 AS n_rows, 3 AS n_columns, string_agg('||' || p_size, ';' ORDER BY j) FILTER (j <= 2) AS samples FROM b GROUP BY book")
def workbook_profiles(s, d):
    got = workbooks.profile(workbooks.cells(workbooks.relevant(_books(s, d), ["SIZE"]), [2]))
    return got.select("book", "sheet", F.array_join("headers", "|").alias("headers"), "n_rows", "n_columns", F.array_join(F.transform("samples", lambda c: F.array_join(c, "|")), ";").alias("samples"))


GOOD = "good AS (SELECT * FROM orders WHERE o_custkey % 7 <> 0 AND o_custkey % 11 <> 0), c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), g AS (SELECT * FROM c WHERE o_custkey % 7 <> 0 AND o_custkey % 11 <> 0), tagged AS (SELECT * FROM good WHERE o_orderkey % 2 = 0)"


@query(f"""WITH {GOOD}, all_ AS (SELECT '$' AS path, CASE WHEN o_custkey % 11 = 0 THEN 'missing' WHEN o_custkey % 7 = 0 THEN 'invalid' ELSE 'object' END AS kind, count(*) AS n, NULL::DOUBLE AS least, NULL::DOUBLE AS most FROM c GROUP BY kind
UNION ALL SELECT '$.id', 'number', count(*), min(o_custkey), max(o_custkey) FROM g UNION ALL SELECT '$.even', 'boolean', count(*), NULL, NULL FROM g UNION ALL SELECT '$.orders', 'array', count(*), min(n), max(n) FROM g
UNION ALL SELECT '$.orders[]', 'object', count(*), NULL, NULL FROM good UNION ALL SELECT '$.orders[].key', 'number', count(*), min(o_orderkey), max(o_orderkey) FROM good UNION ALL SELECT '$.orders[].about', 'object', count(*), NULL, NULL FROM good
UNION ALL SELECT '$.orders[].about.status', 'string', count(*), min(length(o_orderstatus)), max(length(o_orderstatus)) FROM good UNION ALL SELECT '$.orders[].about.tags', 'array', count(*), 2, 2 FROM tagged
UNION ALL SELECT '$.orders[].about.tags[]', 'string', 2 * count(*), 1, max(length(o_orderpriority)) FROM tagged) SELECT * FROM all_ WHERE n > 0""")
def json_shapes(s, d):
    return sketch.shapes(sketch.rendered(tables.table(s, d, "orders")), "json")


@query(f"""WITH {GOOD} SELECT o_custkey AS doc_id, '$.id' AS path, 'number' AS kind, CAST(o_custkey AS VARCHAR) AS value FROM g UNION ALL SELECT o_custkey, '$.even', 'boolean', CASE o_custkey % 2 WHEN 0 THEN 'true' ELSE 'false' END FROM g
UNION ALL SELECT o_custkey, '$.orders[].key', 'number', CAST(o_orderkey AS VARCHAR) FROM good UNION ALL SELECT o_custkey, '$.orders[].about.status', 'string', o_orderstatus FROM good
UNION ALL SELECT o_custkey, '$.orders[].about.tags[]', 'string', unnest([o_orderpriority, 'x']) FROM tagged""")
def json_scalars(s, d):
    return sketch.scalars(sketch.rendered(tables.table(s, d, "orders")), "doc_id", "json")
