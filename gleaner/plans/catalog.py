"""Registered queries over whole tables, each beside the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import denoise, evidence, extract, gate, items, profile, relevance, segments, slots, units, usage
from ..sources import tables
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401

SLOTS = ("STATUS", "TOTAL", "DATE", "PRIORITY")
HINTS = ["order", "price"]
#: Requests of the needle queries: literal rows; two common words and one that no text holds.
REQUESTS = [
    ("r1", ["the", "and", "zzqx"], ["and"], "count", 900),
    ("r2", ["password", "token", "secret"], ["secret"], "fact", 1800),
    ("r3", ["license", "copyright"], [], "list", 3500),
]

RUN = r"'[ \t\r\n\f\v]+'"
LINES = "lines AS (SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
ORDERS = """rendered AS (SELECT o_custkey AS doc_id, '# Customer ' || o_custkey || chr(10) || chr(10) || string_agg('- order ' || o_orderkey || chr(10) || 'STATUS: ' || o_orderstatus || chr(10)
  || 'TOTAL: ' || CAST(floor(o_totalprice) AS BIGINT) || chr(10) || 'DATE: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'PRIORITY: ' || o_orderpriority, chr(10) || chr(10) ORDER BY o_orderkey) AS text
  FROM orders GROUP BY o_custkey),
lines AS (SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM rendered))"""
LOG = """lines AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END || ' ' || event_type AS line FROM events)"""
ANCHOR = "'L' || (idx + 1) || '-L' || (idx + 1)"
STAMP = r"'^\[?[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}\]?[ \t]*'"


def _runs(body: str) -> str:
    return f"""marked AS (SELECT doc_id, idx, {body} AS body FROM lines),
new AS (SELECT *, CASE WHEN lag(body) OVER w IS NOT DISTINCT FROM body THEN 0 ELSE 1 END AS n FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
run AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY idx) AS r FROM new)
SELECT doc_id, min(idx) AS start, count(*) AS run_length, any_value(body) AS body FROM run GROUP BY doc_id, r HAVING count(*) >= 3 AND any_value(body) <> ''"""


def _asked() -> str:
    rows = ", ".join(f"('{r}', {n!r}, {m!r}, '{w}', {b})" for r, n, m, w, b in REQUESTS).replace("[]", "[]::VARCHAR[]")
    return f"asked(request_id, needles, must_keep, want, budget) AS (VALUES {rows})"


SCORED = f"""{_asked()}, {LINES},
hits AS (SELECT request_id, want, budget, doc_id, idx, line, list_sum(list_transform(needles, lambda n: CASE WHEN contains(lower(line), lower(n)) THEN CASE WHEN list_contains(must_keep, n) THEN 4.0 ELSE 2.0 END ELSE 0.0 END)) AS p FROM lines, asked),
scored AS (SELECT request_id, budget, doc_id, idx, line, CAST(p AS DOUBLE) + CASE WHEN want IN ('count', 'fact') AND regexp_matches(line, '[0-9]') THEN CAST(0.8 AS DOUBLE) ELSE 0 END AS score FROM hits WHERE p > 0)"""
RANKED = SCORED + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id, idx) AS rank FROM scored)"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return tables.table(s, d, "documents")


def _lines(s: SparkSession, d: str) -> DataFrame:
    return units.lines(_docs(s, d))


def _orders(s: SparkSession, d: str) -> DataFrame:
    return tables.rendered_orders(tables.table(s, d, "orders"))


def _log(s: SparkSession, d: str) -> DataFrame:
    return tables.rendered_log(tables.table(s, d, "events"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    return evidence.scores(_lines(s, d), evidence.requests(s, REQUESTS))


@query("SELECT doc_id, length(text) AS n_chars, length(text) >= 4096 AS large, greatest(1, length(text) // 4) AS n_tokens FROM documents")
def doc_size_class(s, d):
    return profile.size_class(_docs(s, d))


@query(f"WITH {LINES}, " + _runs(f"trim(regexp_replace(line, {RUN}, ' ', 'g'))"))
def line_runs(s, d):
    return units.runs(_lines(s, d), units.squeezed(F.col("line")))


@query(f"WITH {LOG}, " + _runs(f"regexp_replace(line, {STAMP}, '')"))
def volatile_runs(s, d):
    return units.runs(_log(s, d), F.regexp_replace("line", units.STAMP, ""))


@query(f"WITH {LINES} SELECT doc_id, {ANCHOR} AS anchor, length(line) AS n_chars, regexp_matches(line, '^[ \\t]*([-*]|[0-9]+[.)])[ \\t]+') AS is_list, regexp_matches(line, '[0-9]') AS has_number FROM lines WHERE trim(line) <> ''")
def line_units(s, d):
    return units.line_units(_lines(s, d))


@query(f"""WITH {ORDERS}, par AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS p FROM lines)
SELECT doc_id, 'L' || (min(idx) + 1) || '-L' || (max(idx) + 1) AS anchor, string_agg(line, chr(10) ORDER BY idx) AS text FROM par WHERE trim(line) <> '' GROUP BY doc_id, p""")
def paragraph_units(s, d):
    return units.paragraphs(units.lines(_orders(s, d)))


@query(f"""WITH {ORDERS}, h AS (SELECT *, max(CASE WHEN regexp_matches(line, '^#+[ \\t]+') THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx) AS hd FROM lines),
names AS (SELECT doc_id, idx AS hd, regexp_replace(line, '^#+[ \\t]+', '') AS heading FROM lines WHERE regexp_matches(line, '^#+[ \\t]+'))
SELECT h.doc_id, heading, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '^- ')) AS n_items FROM h JOIN names USING (doc_id, hd) WHERE idx > hd AND trim(line) <> '' GROUP BY h.doc_id, hd, heading""")
def heading_skeleton(s, d):
    return units.headings(units.lines(_orders(s, d)))


@query(f"WITH {ORDERS} SELECT doc_id, idx, line FROM lines WHERE regexp_matches(line, '^[ \\t]*([-*]|[0-9]+[.)])[ \\t]+')")
def list_items(s, d):
    return units.lines(_orders(s, d)).where(F.col("line").rlike(units.LIST_ITEM)).select("doc_id", "idx", "line")


@query(f"WITH {ORDERS} SELECT doc_id, idx, regexp_extract(line, '^([A-Z]+): (.*)$', 1) AS name, regexp_extract(line, '^([A-Z]+): (.*)$', 2) AS value FROM lines WHERE regexp_matches(line, '^[A-Z]+: ')")
def field_values(s, d):
    return units.fields(units.lines(_orders(s, d)))


@query(f"WITH {ORDERS} SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS date FROM rendered")
def date_extract(s, d):
    return _orders(s, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(units.ISO_DATE), F.lit(0))).alias("date"))


@query(f"WITH {SCORED} SELECT request_id, doc_id, idx, score FROM scored")
def needle_scores(s, d):
    return _scored(s, d).select("request_id", "doc_id", "idx", "score")


@query(f"WITH {RANKED} SELECT request_id, rank, doc_id, {ANCHOR} AS anchor, score, length(line) AS n_chars FROM ranked WHERE rank <= 12")
def needle_topk(s, d):
    return evidence.cards(evidence.top(_scored(s, d), 12))


@query(f"""WITH RECURSIVE {RANKED}, blocks AS (SELECT request_id, budget, rank, length({ANCHOR}) + length(line) + 32 AS cost, doc_id || ':' || {ANCHOR} AS name FROM ranked WHERE rank <= 40),
fold AS (SELECT request_id, budget, CAST(1 AS BIGINT) AS rank, CAST(1 AS BIGINT) AS n_picked, CAST(cost AS BIGINT) AS used, name AS anchors FROM blocks WHERE rank = 1
 UNION ALL SELECT f.request_id, f.budget, b.rank, CASE WHEN ok THEN n_picked + 1 ELSE n_picked END, CASE WHEN ok THEN used + cost ELSE used END, CASE WHEN ok THEN anchors || ',' || name ELSE anchors END
 FROM (SELECT *, rank + 1 AS nr FROM fold) f JOIN blocks b ON b.request_id = f.request_id AND b.rank = f.nr, LATERAL (SELECT n_picked < 12 AND used < f.budget AND used + cost <= f.budget AS ok) o)
SELECT request_id, n_picked, used, anchors FROM fold QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY rank DESC) = 1""")
def budget_pick(s, d):
    return evidence.picked(evidence.top(_scored(s, d), 40))


@query(f"WITH {_asked()}, {LINES}, wanted AS (SELECT DISTINCT request_id, unnest(needles) AS needle FROM asked) SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM lines WHERE contains(lower(line), lower(w.needle)))")
def unresolved_needles(s, d):
    return evidence.unresolved(_lines(s, d), evidence.requests(s, REQUESTS))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''")
def benchmark_overlap(s, d):
    return evidence.contained(_docs(s, d), tables.table(s, d, "benchmark"))


@query("""WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9][0-9,]*'), lambda x: replace(x, ',', '')) AS l FROM documents)
SELECT doc_id, len(l) AS n_numbers, len(list_filter(l, lambda x: length(x) = 4 AND x >= '1900' AND x <= '2100')) AS n_years FROM n WHERE len(l) > 0""")
def number_extract(s, d):
    return profile.numbers(_docs(s, d))


def _types(table: str) -> str:
    every = lambda p: f"bool_and(regexp_matches(v, '{p}')) FILTER (v <> '')"
    return f"""WITH m AS (SELECT name, trim(value) AS v FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM {table}) UNPIVOT INCLUDE NULLS (value FOR name IN (*)))
SELECT name, CASE WHEN count(*) FILTER (v <> '') = 0 THEN 'empty' WHEN {every('^[-+]?[0-9]+$')} THEN 'integer' WHEN {every('^[-+]?([0-9]+[.][0-9]+|[0-9]+)$')} THEN 'number'
WHEN {every('[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}')} THEN 'date' ELSE 'string' END AS type, count(*) AS n_rows, count(*) FILTER (v <> '') AS n_filled FROM m GROUP BY name"""


@query(_types("orders"))
def column_types(s, d):
    return profile.column_types(tables.table(s, d, "orders"))


@query(_types("customer"))
def column_types_customer(s, d):
    return profile.column_types(tables.table(s, d, "customer"))


@query(f"""WITH m AS (SELECT name, value FROM (SELECT s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier) UNPIVOT (value FOR name IN (*)))
SELECT name, value, regexp_matches(lower(value), '{profile.ERROR_LIKE}') AS error_like FROM m GROUP BY name, value HAVING count(*) = 1""")
def rare_values(s, d):
    return profile.rare_values(tables.table(s, d, "supplier").select("s_name", "s_nationkey"))


@query(rf"""WITH {LOG}, bare AS (SELECT line, regexp_replace(regexp_replace(line, '^\s*\d{{4}}[-/]\d\d[-/]\d\d[ T]\d\d:\d\d:\d\d([.,]\d+)?\s*', ''), '^\s*\[[^\]]*\]\s*', '') AS x FROM lines),
signs AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(x, '\b0x[0-9a-fA-F]+\b', '0x<hex>', 'g'), '\b\d{{4,}}\b', '<num>', 'g'), '\s+', ' ', 'g')) AS value, count(*) AS n FROM bare GROUP BY 1 HAVING count(*) > 1),
named AS (SELECT upper(regexp_extract(line, '(?i)\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL)\b', 1)) AS l FROM lines)
SELECT 'level' AS kind, CASE l WHEN 'WARNING' THEN 'WARN' ELSE l END AS value, count(*) AS n FROM named WHERE l <> '' GROUP BY 2
UNION ALL (SELECT 'signature', value, n FROM signs ORDER BY n DESC, value LIMIT 8)""")
def severity_counts(s, d):
    return profile.severities(_log(s, d))


@query("""SELECT key, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT props, unnest(json_keys(props)) AS k FROM events)) GROUP BY key""")
def json_keys(s, d):
    return profile.json_keys(tables.table(s, d, "events"), "props")


@query(r"""WITH t AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS x FROM pages)
SELECT page_id, length(html) AS n_html, length(x) AS n_text, sha256(x) AS text_sha256 FROM t""")
def html_text_stats(s, d):
    return profile.pages(tables.table(s, d, "pages"))


@query("""WITH r AS (SELECT source, doc_id, strlen(text) AS b, row_number() OVER (PARTITION BY source ORDER BY strlen(text) DESC, doc_id) AS r FROM documents)
SELECT source, count(*) AS n_files, CAST(sum(b) AS BIGINT) AS n_bytes, count(*) FILTER (b >= 4096) AS n_large, string_agg(doc_id, ',' ORDER BY r) FILTER (r <= 12) AS notable FROM r GROUP BY source""")
def collection_stats(s, d):
    return profile.collections(_docs(s, d))


GOALS = "goals(goal) AS (VALUES " + ", ".join(f"('{g}')" for g in gate.GOALS) + ")"


@query(f"""WITH {GOALS}, o AS (SELECT doc_id, goal, strlen(text) AS size FROM documents, goals), g AS (SELECT doc_id, goal, CASE WHEN size < 4096 THEN 'native|below_benefit_floor|0.95'
WHEN goal IN ('full_fidelity', 'edit_or_execute') THEN 'native|native_' || goal || '|0.95' WHEN goal = 'selective_read' THEN 'force|long_document_selective|0.9' ELSE 'force|long_document|0.82' END AS r FROM o)
SELECT doc_id, goal, split_part(r, '|', 1) AS mode, split_part(r, '|', 2) AS code, CAST(split_part(r, '|', 3) AS DOUBLE) AS confidence FROM g""")
def gate_decision(s, d):
    found = _docs(s, d).select("doc_id", F.octet_length("text").cast("long").alias("size"), F.lit("text").alias("type"), F.lit("md").alias("ending"), F.explode(F.array(*[F.lit(g) for g in gate.GOALS])).alias("goal"))
    return gate.objects(found, "doc_id", "goal")


@query(f"""WITH {GOALS}, c AS (SELECT source, count(*) AS n, sum(strlen(text)) AS b FROM documents GROUP BY source), g AS (SELECT source, goal, CASE WHEN goal = 'full_fidelity' THEN 'native|native_full_fidelity|0.95'
WHEN goal = 'edit_or_execute' THEN 'native|native_edit_or_execute|0.95' WHEN goal = 'structured_compute' THEN 'native|native_small_structured_compute|0.9'
WHEN goal = 'cross_file_evidence' AND n >= 3 AND b >= 8192 THEN 'force|multi_file_evidence|0.9' WHEN goal = 'cross_file_evidence' THEN 'advisory|multi_file_evidence_boundary|0.68'
WHEN b >= 24576 OR n >= 8 THEN 'advisory|large_text_collection_boundary|0.72' WHEN b >= 8192 OR n >= 3 THEN 'advisory|collection_goal_required|0.62' ELSE 'native|small_collection|0.9' END AS r FROM c, goals)
SELECT source, goal, split_part(r, '|', 1) AS mode, split_part(r, '|', 2) AS code, CAST(split_part(r, '|', 3) AS DOUBLE) AS confidence FROM g""")
def gate_collection(s, d):
    stats = gate.measured(_docs(s, d).select("source", F.octet_length("text").cast("long").alias("size"), F.lit("text").alias("kind")), "source")
    return gate.collections(stats.withColumn("goal", F.explode(F.array(*[F.lit(g) for g in gate.GOALS]))), "source", "goal")


@query(f"""WITH {ORDERS}, asked AS (SELECT doc_id, unnest({list(SLOTS)!r}) AS slot FROM rendered), f AS (SELECT doc_id, idx, split_part(line, ': ', 1) AS slot, regexp_replace(line, '^[A-Z]+: ', '') AS value FROM lines WHERE regexp_matches(line, '^[A-Z]+: ')),
a AS (SELECT doc_id, slot, arg_min(value, idx) AS value, min(idx) AS idx FROM f GROUP BY doc_id, slot), j AS (SELECT asked.doc_id, asked.slot, CASE WHEN value IS NULL THEN 'missing' WHEN trim(value) = '' THEN 'partial' ELSE 'resolved' END AS st FROM asked LEFT JOIN a USING (doc_id, slot))
SELECT doc_id, count(*) FILTER (st = 'resolved') AS n_resolved, count(*) AS n_slots, CASE WHEN bool_and(st = 'resolved') THEN 'ready' WHEN bool_and(st IN ('resolved', 'partial')) THEN 'needs_verify' ELSE 'needs_refine' END AS status FROM j GROUP BY doc_id""")
def slot_status(s, d):
    docs = _orders(s, d)
    return slots.status(slots.demoted(slots.answers(docs, units.fields(units.lines(docs)), SLOTS)))


@query("SELECT * EXCLUDE (o_custkey) FROM orders")
def header_projection(s, d):
    orders = tables.table(s, d, "orders")
    return orders.select(*profile.hinted(orders.columns, HINTS))


@query("""WITH t AS (SELECT *, lower('s_suppkey=' || s_suppkey || ' | s_name=' || s_name || ' | s_nationkey=' || s_nationkey) AS x FROM (SELECT s_suppkey, s_name, s_nationkey FROM supplier))
SELECT s_suppkey, s_name, s_nationkey, CAST(CASE WHEN contains(x, '7') THEN 2 ELSE 0 END + CASE WHEN contains(x, 's_nationkey=1') THEN 2 ELSE 0 END AS DOUBLE) + 0.5 AS score FROM t
WHERE contains(x, '7') OR contains(x, 's_nationkey=1') ORDER BY score DESC, s_suppkey, s_name, s_nationkey LIMIT 40""")
def csv_row_match(s, d):
    return profile.row_match(tables.table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), ["7", "s_nationkey=1"])


@query(f"""WITH {LINES}, h AS (SELECT *, regexp_matches(line, '[0-9]') AS is_hit FROM lines), n AS (SELECT *, max(CAST(is_hit AS INT)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM h)
SELECT doc_id, idx, line, is_hit, coalesce(idx - lag(idx) OVER (PARTITION BY doc_id ORDER BY idx) > 1, false) AS gap FROM n WHERE near = 1""")
def context_lines(s, d):
    return units.context(_lines(s, d), F.col("line").rlike("[0-9]"))


@query(f"""WITH {LINES}, e AS (SELECT doc_id, sum(greatest(1, length(line) // 4)) AS e FROM lines WHERE regexp_matches(line, '[0-9]') GROUP BY doc_id)
SELECT lang, source, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS "full", CAST(coalesce(sum(e), 0) AS BIGINT) AS evidence, count(*) AS n FROM documents LEFT JOIN e USING (doc_id) GROUP BY ROLLUP (lang, source)""")
def token_savings(s, d):
    return usage.savings(_docs(s, d), _lines(s, d))


@query("""SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_errors, count(*) FILTER (event_type = 'view') AS n_views, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY user_id""")
def trace_summary(s, d):
    return usage.trace(tables.table(s, d, "events"))


@query("SELECT quality, toxic, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents JOIN labels USING (doc_id) GROUP BY quality, toxic")
def labels_join(s, d):
    return usage.by_label(_docs(s, d), tables.table(s, d, "labels"))


@query("""WITH e AS (SELECT *, sum(CAST(event_type = 'signup' AS INT)) OVER w AS episode,
 last_value(CASE WHEN event_type IN ('signup', 'error') THEN 'open' WHEN event_type = 'purchase' THEN 'ready' END IGNORE NULLS) OVER w AS state,
 last_value(CASE WHEN event_type IN ('signup', 'error') THEN 'open' WHEN event_type = 'purchase' THEN 'ready' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CAST(episode AS INT) AS episode, count(*) AS n_events, count(*) FILTER (before = 'ready' AND event_type NOT IN ('signup', 'error', 'purchase')) AS n_after_ready, coalesce(arg_max(state, (ts, event_id)), 'open') AS state FROM e GROUP BY user_id, episode""")
def episode_batch(s, d):
    return usage.episodes(tables.table(s, d, "events"))


@query()
def denoised_documents(s, d):
    made = denoise.denoised(_docs(s, d))
    return made.select("doc_id", "input_chars", "output_chars", "rules", F.sha2("text", 256).alias("text_sha256"))


@query()
def denoised_pages(s, d):
    made = denoise.denoised(tables.table(s, d, "pages"), "page_id", "html", "html", 0)
    return made.select("page_id", "input_chars", "output_chars", "rules", F.sha2("text", 256).alias("text_sha256"))


@query()
def text_segments(s, d):
    return segments.segments(_docs(s, d)).select("doc_id", "idx", "anchor", F.length("text").cast("long").alias("n_chars"), "heading")


@query()
def heading_outline(s, d):
    return segments.skeleton(segments.segments(_orders(s, d)))


@query()
def document_items(s, d):
    return items.items(_docs(s, d))


@query("""WITH k AS (SELECT event_id, props, json_keys(props) AS ks FROM events), e AS (SELECT event_id, props, unnest(range(len(ks))) AS i, unnest(ks) AS key FROM k)
SELECT event_id, CAST(i AS INT) AS idx, '$.' || key AS path, json_extract_string(props, '$.' || key) AS value FROM e""")
def props_paths(s, d):
    return items.key_paths(tables.table(s, d, "events"), "event_id", "props")


#: Non-blank lines of the rendered orders with the heading above them.
UNITS = f"""{ORDERS}, u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS idx, {ANCHOR} AS anchor, line AS text,
last_value(CASE WHEN regexp_matches(line, '^#+ ') THEN regexp_replace(line, '^#+ ', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx) AS heading FROM lines WHERE trim(line) <> ''),
hay AS (SELECT *, lower(coalesce(heading, '') || chr(10) || text) AS hay FROM u)"""
URGENT = relevance.Request("status of urgent orders", ("STATUS: F", "1-URGENT", "total 5-LOW"), ("1-URGENT",), "fact")
FIRST_URGENT = relevance.Request("the section of urgent orders", ("PRIORITY: 1-URGENT",))
_HAS = lambda t, n: f"CASE WHEN contains(hay, '{t}') THEN {n} ELSE 0 END"
BEST = f"""{UNITS}, scored AS (SELECT *, CAST({' + '.join([_HAS('status: f', 2), _HAS('1-urgent', 4), _HAS('total 5-low', 2), _HAS('1-urgent', 4), _HAS('status', 2), _HAS('urgent', 2), _HAS('orders', 2)])} AS DOUBLE)
+ CASE WHEN regexp_matches(text, '\\b[0-9]+([.,][0-9]+)?\\b') THEN 0.8 ELSE 0 END + CASE WHEN regexp_matches(text, '^\\s*([-*]|[0-9]+[.)])\\s+\\S') THEN 0.4 ELSE 0 END + 0.3 AS score FROM hay),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 4) DESC, idx) AS rank FROM scored)"""


def _units(s, d, docs=None):
    line = F.col("line")
    by = W.partitionBy("doc_id").orderBy("idx")
    found = units.lines(_orders(s, d) if docs is None else docs).where(F.trim("line") != "")
    heading = F.last(F.when(line.rlike("^#+ "), F.regexp_replace(line, "^#+ ", "")), ignorenulls=True).over(by)
    return found.select("doc_id", (F.row_number().over(by) - 1).cast("long").alias("idx"), units.anchor(F.col("idx"), F.col("idx")).alias("anchor"), line.alias("text"), heading.alias("heading"))


def _best(s, d):
    return relevance.best(relevance.scored(_units(s, d), URGENT).withColumn("score", F.round("score", 4)), 5)


@query(f"WITH {BEST} SELECT doc_id, rank, anchor, text, round(score, 4) AS score FROM best WHERE rank <= 5")
def unit_scores(s, d):
    return _best(s, d).select("doc_id", "rank", "anchor", "text", "score")


@query(f"""WITH {BEST}, e AS (SELECT doc_id, lower(string_agg(text, chr(10))) AS t FROM best WHERE rank <= 5 GROUP BY doc_id)
SELECT doc_id, needle FROM e, (VALUES ('STATUS: F'), ('1-URGENT'), ('total 5-LOW')) n(needle)
WHERE NOT (contains(t, lower(needle)) OR CASE needle WHEN 'STATUS: F' THEN contains(t, 'status:') WHEN 'total 5-LOW' THEN contains(t, 'total') AND contains(t, '5-low') ELSE false END)""")
def unresolved_evidence(s, d):
    return relevance.unresolved(_best(s, d), URGENT)


@query(f"WITH {UNITS} SELECT doc_id, idx + 1 AS rank, anchor, text, CAST(0.2 AS DOUBLE) AS score FROM u WHERE idx < 3")
def unit_overview(s, d):
    return relevance.overview(_units(s, d))


@query(f"""WITH {UNITS}, n AS (SELECT *, min(CASE WHEN contains(hay, 'priority: 1-urgent') THEN idx END) OVER (PARTITION BY doc_id) AS start FROM hay),
c AS (SELECT *, idx - start AS o, sum(length(anchor) + length(text) + 32) OVER (PARTITION BY doc_id ORDER BY idx) AS used FROM n WHERE idx BETWEEN start AND start + 9)
SELECT doc_id, idx, anchor, text, round(CASE WHEN o = 0 THEN 8.0 ELSE greatest(1.0, 7.0 - o * 0.4) END::DOUBLE, 4) AS score FROM c WHERE used <= 400 OR o = 0""")
def unit_section(s, d):
    return relevance.section(_units(s, d), FIRST_URGENT, 400).withColumn("score", F.round("score", 4))


@query(f"""WITH {ORDERS}, asked AS (SELECT doc_id, unnest({list(SLOTS)!r}) AS slot FROM rendered), f AS (SELECT doc_id, idx, {ANCHOR} AS anchor, split_part(line, ': ', 1) AS slot, regexp_replace(line, '^[A-Z]+: ', '') AS value FROM lines WHERE regexp_matches(line, '^[A-Z]+: ')),
a AS (SELECT doc_id, slot, arg_min(value, idx) AS value, arg_min(anchor, idx) AS anchor FROM f GROUP BY doc_id, slot)
SELECT doc_id, slot, 'resolved' AS status, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS value, anchor, CAST(0.99 AS DOUBLE) AS confidence FROM asked JOIN a USING (doc_id, slot)""")
def slot_collect(s, d):
    return extract.collected(_units(s, d), [extract.Slot(n) for n in SLOTS])


ACCOUNT_SLOTS = [
    extract.Slot("first_signed", "When was the first order signed?", "date"),
    extract.Slot("left_over", "How many orders remained after filtering?"),
    extract.Slot("went", "Where did the holder go?"),
    extract.Slot("sailed_again", "Where did the holder sail?"),
    extract.Slot("top", "What is the second category?"),
    extract.Slot("towns", "list the towns taken"),
    extract.Slot("billing", "Which API was billed?"),
    extract.Slot("zebra", "Any zebra?"),
]


@query("""WITH a AS (SELECT o_custkey AS doc_id, strftime(min(o_orderdate), '%-d %B %Y') AS first, format('{:,}', sum(CAST(floor(o_totalprice) AS BIGINT))) AS total, count(*) AS n,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS u, count(*) FILTER (o_orderpriority = '5-LOW') AS l, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE 1 END AS k FROM orders GROUP BY o_custkey),
p AS (SELECT *, ['Jaffa', 'Acre', 'Cyprus'][doc_id % 3 + 1] AS place FROM a),
x AS (SELECT doc_id, 'first_signed' AS slot, 'resolved' AS status, first AS value, 2 AS line, 0.88 AS confidence FROM p
 UNION ALL SELECT doc_id, 'left_over', 'resolved', CASE WHEN n > 20 THEN CAST(n AS VARCHAR) ELSE total END, 3 + k, 0.98 FROM p
 UNION ALL SELECT doc_id, 'went', CASE k WHEN 0 THEN 'missing' ELSE 'partial' END, CASE k WHEN 0 THEN '' ELSE place END, CASE k WHEN 0 THEN NULL ELSE 3 END, CASE k WHEN 0 THEN 0.0 ELSE 0.6 END FROM p
 UNION ALL SELECT doc_id, 'sailed_again', CASE k WHEN 0 THEN 'missing' ELSE 'partial' END, CASE k WHEN 0 THEN '' ELSE place END, CASE k WHEN 0 THEN NULL ELSE 3 END, CASE k WHEN 0 THEN 0.0 ELSE 0.6 END FROM p
 UNION ALL SELECT doc_id, 'top', 'resolved', CASE WHEN u >= l THEN 'Low Orders: ' || l ELSE 'Urgent Orders: ' || u END, 4 + k, 0.99 FROM p
 UNION ALL SELECT doc_id, 'towns', 'resolved', 'Arsuf, Jaffa and Acre', 7 + k, 0.8 FROM p
 UNION ALL SELECT doc_id, 'billing', 'partial', '', 3 + k, 0.35 FROM p
 UNION ALL SELECT doc_id, 'zebra', 'missing', '', NULL, 0.0 FROM p)
SELECT doc_id, slot, status, value, 'L' || line || '-L' || line AS anchor, CAST(confidence AS DOUBLE) AS confidence FROM x""")
def typed_answers(s, d):
    return extract.collected(_units(s, d, tables.rendered_accounts(tables.table(s, d, "orders"))), ACCOUNT_SLOTS)
