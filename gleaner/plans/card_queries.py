"""Queries of cards, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import cards, files, gate
from ..sources import tables
from .catalog import UNITS, _units
from .collection_queries import ENDING, FILES, _files
from .registry import query

#: Log lines with stamps, tags, hexadecimal and long numbers, five spellings of levels and none.
RICH = """k AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, ts, event_type AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
l AS (SELECT doc_id, idx, CASE t WHEN 'error' THEN CASE k % 2 WHEN 0 THEN 'ERROR' ELSE 'FATAL' END WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'INFO' ELSE '' END AS level,
 CASE t WHEN 'error' THEN CASE k % 2 WHEN 0 THEN 'ERROR' ELSE 'fatal' END WHEN 'purchase' THEN 'Warning' WHEN 'view' THEN 'info' ELSE 'informed' END || '  took <num> at 0x<hex> ' || t AS sign,
 strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [svc' || (k % 3) || '] ' || CASE t WHEN 'error' THEN CASE k % 2 WHEN 0 THEN 'ERROR' ELSE 'fatal' END WHEN 'purchase' THEN 'Warning' WHEN 'view' THEN 'info' ELSE 'informed' END || '  took ' || (10000 + k) || ' at 0x' || k || 'af ' || t AS line FROM k)"""


def _log(s, d):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    word = F.when(F.col("event_type") == "error", F.when(k % 2 == 0, "ERROR").otherwise("fatal")).when(F.col("event_type") == "purchase", "Warning").when(F.col("event_type") == "view", "info").otherwise("informed")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" [svc"), (k % 3).cast("string"), F.lit("] "), word, F.lit("  took "), (k + 10_000).cast("string"), F.lit(" at 0x"), k.cast("string"), F.lit("af "), F.col("event_type"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return tables.table(s, d, "events").select(F.col("user_id").alias("doc_id"), place.cast("long").alias("idx"), line.alias("line"))


@query(f"""WITH {RICH}, n AS (SELECT doc_id, level, count(*) AS n FROM l GROUP BY ALL), v AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, coalesce(string_agg(level || '=' || n, ' ' ORDER BY level) FILTER (level <> ''), '') AS levels FROM n GROUP BY doc_id),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS r FROM l WHERE level IN ('ERROR', 'WARN', 'FATAL')), o AS (SELECT doc_id, string_agg((idx + 1) || ':' || level || ':' || line, '|' ORDER BY r) AS notable FROM t WHERE r <= 12 GROUP BY doc_id),
s AS (SELECT doc_id, regexp_replace(sign, ' +', ' ', 'g') AS sign, count(*) AS n FROM l GROUP BY ALL HAVING count(*) > 1), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, sign) AS r FROM s), p AS (SELECT doc_id, string_agg(sign || '=' || n, '|' ORDER BY r) AS repeated FROM q WHERE r <= 8 GROUP BY doc_id)
SELECT doc_id, n_lines, levels, coalesce(notable, '') AS notable, coalesce(repeated, '') AS repeated FROM v LEFT JOIN o USING (doc_id) LEFT JOIN p USING (doc_id)""")
def log_cards(s, d):
    pairs = lambda c, sep: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["sign"], x["n"].cast("string"))), sep)
    levels = F.array_join(F.transform(F.map_entries("levels"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), " ")
    notable = F.array_join(F.transform("notable", lambda x: F.concat_ws(":", x["line"].cast("string"), x["level"], x["text"])), "|")
    return cards.logs(_log(s, d)).select("doc_id", "n_lines", levels.alias("levels"), F.coalesce(notable, F.lit("")).alias("notable"), F.coalesce(pairs(F.col("repeated"), "|"), F.lit("")).alias("repeated"))


@query(f"""WITH {UNITS} SELECT doc_id, count(*) AS n_units, CAST(sum(length(text)) AS BIGINT) AS n_chars, coalesce(min(heading), '') AS headings, string_agg(anchor || ' ' || text, '|' ORDER BY idx) FILTER (idx < 5) AS samples FROM u GROUP BY doc_id""")
def text_cards(s, d):
    samples = F.array_join(F.transform("samples", lambda x: F.concat_ws(" ", x["anchor"], x["text"])), "|")
    return cards.texts(_units(s, d)).select("doc_id", "n_units", "n_chars", F.coalesce(F.array_join("headings", "|"), F.lit("")).alias("headings"), samples.alias("samples"))


@query(f"""WITH {FILES}, n AS (SELECT *, string_split(path, '/') AS parts FROM files), e AS (SELECT *, parts[3] AS collection, parts[-1] AS name FROM n WHERE len(parts) > 3), f AS (SELECT *, {ENDING} AS kind, row_number() OVER (PARTITION BY collection ORDER BY size DESC, path) AS r FROM e),
c AS (SELECT collection, kind, count(*) AS n FROM f GROUP BY ALL), m AS (SELECT collection, string_agg(kind || '=' || n, ' ' ORDER BY kind) AS kinds FROM c GROUP BY collection)
SELECT collection, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes, any_value(kinds) AS kinds, string_agg(path, '|' ORDER BY r) FILTER (r <= 12) AS notable FROM f JOIN m USING (collection) GROUP BY collection""")
def collection_cards(s, d):
    own = _files(s, d).where(F.size(F.split("path", "/")) > 3)
    items = own.select(F.split("path", "/")[2].alias("collection"), F.col("path").alias("name"), files.ending_of(F.col("path")).alias("kind"), "size")
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), " ")
    return cards.collections(items).select("collection", "n_files", "n_bytes", kinds.alias("kinds"), F.array_join("notable", "|").alias("notable"))


@query(f"""WITH {FILES}, e AS (SELECT path, size, string_split(path, '/')[-1] AS name FROM files), o AS (SELECT path, size, {ENDING} AS ending FROM e),
m AS (SELECT *, size >= CASE WHEN ending IN ('csv', 'xml') THEN 1024 ELSE 4096 END AS large, CASE WHEN ending = 'bin' OR ending = 'py' OR size < CASE WHEN ending IN ('csv', 'xml') THEN 1024 ELSE 4096 END THEN 'native' WHEN ending IN ('csv', 'xml') THEN 'advisory' ELSE 'force' END AS mode FROM o)
SELECT path, mode, CASE WHEN large OR mode <> 'native' THEN 'read_with_goal' ELSE 'native' END AS recommended, 'use_preview,' || CASE WHEN large OR mode <> 'native' THEN 'read_with_goal' ELSE 'native' END || ',raw' AS allowed FROM m""")
def file_actions(s, d):
    found = files.detected(_files(s, d)).withColumn("goal", F.lit("selective_read"))
    decided = gate.objects(found, "path", "large")
    return cards.next_actions(decided).select("path", "mode", "recommended", F.array_join("allowed", ",").alias("allowed"))


@query("""WITH r AS (SELECT *, CASE WHEN s_suppkey % 37 = 5 THEN 'failed ' || s_suppkey ELSE 'ok' END AS state FROM supplier)
SELECT (SELECT count(*) FROM r) AS n_rows, 's_name=string s_nationkey=integer s_suppkey=integer state=string' AS columns, (SELECT string_agg(s_suppkey || ',' || s_name || ',' || s_nationkey || ',' || state, '|' ORDER BY s_suppkey) FROM (SELECT * FROM r ORDER BY s_suppkey LIMIT 5)) AS samples,
 (SELECT coalesce('state:' || string_agg(state, ',' ORDER BY state), '') FROM (SELECT state FROM r WHERE state <> 'ok' ORDER BY state LIMIT 8)) AS signals""")
def table_card(s, d):
    state = F.when(F.col("s_suppkey") % 37 == 5, F.concat(F.lit("failed "), F.col("s_suppkey").cast("string"))).otherwise("ok")
    made = cards.table(tables.table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", state.alias("state")), ["s_suppkey"])
    columns = F.array_join(F.transform(F.map_entries("columns"), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    signals = F.array_join(F.transform(F.map_entries("signals"), lambda e: F.concat_ws(":", e["key"], F.array_join(e["value"], ","))), "|")
    return made.select("n_rows", columns.alias("columns"), F.array_join("samples", "|").alias("samples"), signals.alias("signals"))
