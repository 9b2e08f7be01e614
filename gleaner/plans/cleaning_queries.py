"""Queries of single cleaning rules, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import cleaning
from ..sources import tables
from .registry import query

K = "CAST(json_extract_string(props, '$.k') AS INT)"


@query(f"""SELECT event_id, {K} || ' ' || chr(10) || event_type || chr(10) || 'tail' || chr(9) || 'x' AS text FROM events""")
def controls_cleaned(s, d):
    k = F.get_json_object("props", "$.k")
    dirty = F.concat(F.lit("\x1b[31m\ufeff"), k, F.lit(" \r\n\x1b]0;title\x07\x00"), F.col("event_type"), F.lit("\r\x1b[0mta\u200bil\t\x0bx"))
    return tables.table(s, d, "events").select("event_id", cleaning.controls(dirty).alias("text"))


@query(r"""SELECT o_orderkey, '{"a b":[' || o_orderkey || ',"x  \" y\\"],"s":"' || o_orderstatus || ' ","n":1.50}' AS text FROM orders""")
def json_minified(s, d):
    raw = F.concat(F.lit('{\n  "a b" : [ '), F.col("o_orderkey").cast("string"), F.lit(' ,\t"x  \\" y\\\\" ],\r\n"s": "'), F.col("o_orderstatus"), F.lit(' " , "n" :  1.50 } \n'))
    return tables.table(s, d, "orders").select("o_orderkey", cleaning.minified(raw).alias("text"))


#: Lines of each user: progress, fences, indented progress, blank lines and notes.
LINES = f"""k AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type AS t, {K} AS k FROM events),
l AS (SELECT doc_id, idx, CASE WHEN t IN ('view', 'click', 'purchase') THEN CASE WHEN k % 50 = 0 THEN '    ' ELSE '' END || 'Fetch  ' || k || '% of ' || k || '/100  ' WHEN t = 'error' THEN CASE WHEN k % 3 = 0 THEN ' ```' WHEN k % 3 = 1 THEN '' ELSE 'note' END ELSE 'note' || repeat(' ', k % 3) END AS line FROM k),
f AS (SELECT *, sum(CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS fences FROM l), c AS (SELECT *, starts_with(ltrim(line), '```') OR starts_with(line, '    ') OR fences % 2 = 1 AS code FROM f)"""


def _runs(form: str, least: int, pieces: str) -> str:
    return f"""WITH {LINES}, m AS (SELECT *, CASE WHEN NOT code AND trim(line) <> '' THEN {form} END AS form FROM c), n AS (SELECT *, CASE WHEN form IS NOT NULL AND form = lag(form) OVER (PARTITION BY doc_id ORDER BY idx) THEN 0 ELSE 1 END AS new FROM m),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM n), z AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n, row_number() OVER (PARTITION BY doc_id, run ORDER BY idx) AS place, rtrim(line) AS bare FROM r)
SELECT doc_id, idx, 0 AS part, bare AS line FROM z WHERE n < {least} OR place = 1 {pieces}"""


def _lines(s, d):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    t, said = F.col("event_type"), k.cast("string")
    line = F.when(t.isin("view", "click", "purchase"), F.concat(F.when(k % 50 == 0, "    ").otherwise(""), F.lit("Fetch  "), said, F.lit("% of "), said, F.lit("/100  "))).when(t == "error", F.when(k % 3 == 0, " ```").when(k % 3 == 1, "").otherwise("note")).otherwise(F.concat(F.lit("note"), F.repeat(F.lit(" "), k % 3)))
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return cleaning.protected(tables.table(s, d, "events").select(F.col("user_id").alias("doc_id"), place.cast("long").alias("idx"), line.alias("line")))


@query(f"WITH {LINES} SELECT doc_id, idx, code FROM c")
def protected_lines(s, d):
    return _lines(s, d).select("doc_id", "idx", "code")


@query(_runs("CASE WHEN contains(line, '%') THEN 'p' END", 4, "UNION ALL SELECT doc_id, idx, 1, '[collapsed ' || (n - 2) || ' intermediate progress updates]' FROM z WHERE n >= 4 AND place = 1 UNION ALL SELECT doc_id, idx, 2, bare FROM z WHERE n >= 4 AND place = n"))
def progress_folded(s, d):
    return cleaning.progress_lines(_lines(s, d))


@query(_runs("trim(regexp_replace(line, ' +', ' ', 'g'))", 3, "UNION ALL SELECT doc_id, idx, 1, '[repeated identical line ×' || n || ']' FROM z WHERE n >= 3 AND place = 1"))
def same_lines_folded(s, d):
    return cleaning.same_lines(_lines(s, d))
