"""Queries over requests, paths and what is already known, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paths, readiness, reading, requests
from ..sources import tables
from .catalog import LOG, ORDERS
from .registry import query

_N12 = ", ".join(f"'n{i}'" for i in range(1, 11))


@query(f"""WITH f AS (SELECT p_partkey AS request_id, CAST(p_partkey AS VARCHAR) AS k, p_name, p_partkey % 9 AS form FROM part)
SELECT request_id,
 CASE form WHEN 0 THEN 'find ' || p_name WHEN 1 THEN 'g' || k WHEN 2 THEN 'g' WHEN 7 THEN 'g' WHEN 8 THEN 's' ELSE '' END AS goal,
 CASE form WHEN 0 THEN k || '|x' WHEN 1 THEN 'a|b|' || k WHEN 2 THEN array_to_string([{_N12}], '|') ELSE '' END AS needles,
 CASE form WHEN 1 THEN 'count' WHEN 2 THEN 'table' ELSE 'fact' END AS want, CASE form WHEN 1 THEN 'expand' ELSE 'new' END AS scope, CASE form WHEN 2 THEN 'csv' ELSE 'auto' END AS type_hint, CASE form WHEN 0 THEN 'k' ELSE '' END AS must_keep,
 CASE form WHEN 2 THEN 'needle_overflow_1=Find information about: n11=fact=n11;needle_overflow_2=Find information about: n12=fact=n12' WHEN 3 THEN 'a=Which ' || k || '?=fact=x,y;a_2=Again?=date=;slot_3=How many?=fact=' WHEN 4 THEN 'b=Where?=fact=z;first_one=Who ' || k || '?=fact='
  WHEN 7 THEN 'slot_1=a question in place of an id ' || k || '=fact=;short==fact=' WHEN 8 THEN 'p' || k || '=What is it?=fact=;q=Who was it?=name=' ELSE '' END AS slots,
 CASE form WHEN 1 THEN 'must_keep is no array' WHEN 2 THEN 'needles became slots|scope is unknown' WHEN 3 THEN 'a slot is neither object nor question' WHEN 4 THEN 'want is unknown' WHEN 5 THEN 'goal is missing|needles are no array' WHEN 6 THEN 'no object'
  WHEN 7 THEN 'a slot has no question' ELSE '' END AS warnings FROM f""")
def parsed_requests(s, d):
    got = requests.parsed(requests.rendered(tables.table(s, d, "part")))
    slots = F.transform("slots", lambda x: F.concat_ws("=", x["id"], x["question"], x["expected"], F.array_join(x["aliases"], ",")))
    return got.select("request_id", "goal", F.array_join("needles", "|").alias("needles"), "want", "scope", "type_hint", F.array_join("must_keep", "|").alias("must_keep"), F.array_join(slots, ";").alias("slots"), F.array_join("warnings", "|").alias("warnings"))


PAGES = """p AS (SELECT page_id, rtrim(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS path FROM pages)"""


def _pages(s, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return tables.table(s, d, "pages").select("page_id", path.alias("path"))


@query(f"""WITH {PAGES}, l AS (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN regexp_replace(path, '/[^/]*$', '') WHEN 1 THEN path ELSE path || '/part' END AS scope FROM p)
SELECT scope, page_id, path, CASE WHEN scope = path THEN 'equal' WHEN starts_with(path, scope || '/') THEN 'above' ELSE 'below' END AS relation
FROM l JOIN p ON scope = path OR starts_with(path, scope || '/') OR starts_with(scope, path || '/')""")
def path_relations(s, d):
    pages = _pages(s, d).withColumn("path", paths.bare(F.col("path")))
    scope = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("page_id") % 3 == 1, F.col("path")).otherwise(F.concat("path", F.lit("/part")))
    return paths.related(pages.select(scope.alias("scope")).distinct(), pages, "scope", "path")


@query(f"""WITH {PAGES}, r AS (SELECT DISTINCT CASE page_id % 2 WHEN 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE split_part(path, '/', 1) END AS root FROM p),
m AS (SELECT page_id, max(struct_pack(n := length(root), root := root)) AS b FROM p JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY page_id)
SELECT page_id, path, b.root AS root, CAST(len(string_split(path, '/')) - len(string_split(b.root, '/')) AS INT) AS distance FROM p LEFT JOIN m USING (page_id)""")
def nearest_roots(s, d):
    pages = _pages(s, d).withColumn("path", paths.bare(F.col("path")))
    root = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.split_part("path", F.lit("/"), F.lit(1)))
    return paths.nearest_root(pages, pages.select(root.alias("root")), "path", "root")


@query(f"""WITH {LOG}, a AS (SELECT doc_id, idx FROM lines WHERE contains(line, ' WARN ')), m AS (SELECT *, CASE WHEN idx - lag(idx) OVER w > 4 THEN 1 ELSE 0 END AS n FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY idx) AS r FROM m), t AS (SELECT doc_id, min(idx) - 2 AS low, max(idx) + 1 AS high, count(*) AS n_anchors FROM r GROUP BY doc_id, r)
SELECT lines.doc_id, idx, line, low, high, n_anchors FROM lines JOIN t ON lines.doc_id = t.doc_id AND idx BETWEEN low AND high""")
def anchor_neighbours(s, d):
    lines = tables.rendered_log(tables.table(s, d, "events"))
    return paths.around(lines.where(F.col("line").contains(" WARN ")), lines, 2, 1)


@query("""WITH c AS (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'needs_refine' WHEN c_acctbal < 0 THEN 'needs_verify' ELSE 'ready' END AS state FROM customer),
r AS (SELECT c_custkey, state, unnest(['name', 'balance', 'more', 'when']) AS kind, c_acctbal FROM c)
SELECT c_custkey AS doc_id, kind AS request_id, CASE WHEN state IS NULL THEN 'read' WHEN kind = 'more' THEN 'extend' WHEN state = 'needs_refine' THEN 'refine' WHEN kind = 'when' OR (kind = 'balance' AND state = 'needs_verify') THEN 'verify' WHEN state = 'ready' THEN 'complete' ELSE 'nearly_complete' END AS verdict,
 CASE WHEN kind = 'more' THEN CASE WHEN state IS NULL THEN 'name,phone' ELSE 'phone' END WHEN state IS NULL THEN CASE kind WHEN 'balance' THEN 'balance' ELSE 'name' END ELSE '' END AS new_slots,
 CASE WHEN kind = 'more' THEN CASE WHEN state IS NULL THEN 'name,phone' ELSE 'phone' END WHEN kind = 'balance' THEN CASE WHEN state IS NULL OR c_acctbal < 0 THEN 'balance' ELSE '' END WHEN state IS NULL THEN 'name' ELSE '' END AS open_slots FROM r""")
def readiness_verdicts(s, d):
    customers = tables.table(s, d, "customer")
    key = F.col("c_custkey").alias("doc_id")
    one = lambda slot, status, value, sure: F.struct(F.lit(slot).alias("slot"), status.alias("status"), value.alias("value"), F.lit(sure).alias("confidence"))
    known = F.array(
        one("name", F.lit("resolved"), F.col("c_name"), 0.99),
        one("balance", F.when(F.col("c_acctbal") < 0, "partial").otherwise("resolved"), F.floor("c_acctbal").cast("string"), 0.95),
        one("segment", F.when(F.col("c_custkey") % 4 == 0, "missing").otherwise("resolved"), F.col("c_mktsegment"), 0.9),
    )
    answers = customers.where(F.col("c_custkey") % 10 != 0).select(key, F.explode(known).alias("a")).select("doc_id", "a.*")
    slot = lambda name, asked: F.struct(F.lit(name).alias("id"), F.lit(asked).alias("asked"))
    asked = [("name", "focus", [slot("name", "fact")]), ("balance", "verify", [slot("balance", "How many?")]), ("more", "focus", [slot("name", ""), slot("phone", "")]), ("when", "verify", [slot("name", "When?")])]
    wanted = F.array(*[F.struct(F.lit(i).alias("request_id"), F.lit(m).alias("mode"), F.array(*x).alias("slots")) for i, m, x in asked])
    got = readiness.judged(customers.select(key, F.explode(wanted).alias("r")).select("doc_id", "r.*"), answers)
    return got.select("doc_id", "request_id", "verdict", F.array_join("new_slots", ",").alias("new_slots"), F.array_join("open_slots", ",").alias("open_slots"))


#: Raw requests that each customer's page is read by: kind, mode, budget, JSON.
READS = (
    ("urgent", "verify", 420, '{"goal": "status of urgent orders", "needles": ["STATUS: F", "1-URGENT", "total 5-LOW"], "must_keep": ["1-URGENT"], "want": "facts"}'),
    ("look", "scout", None, '{"goal": "what is it"}'),
    ("section", "refine", 300, '{"goal": "the section of urgent orders", "needles": "PRIORITY: 1-URGENT", "scope": "full"}'),
    ("nothing", None, 200, '{"goal": "", "needles": ["zzz", "customer date"], "slots": [], "want": "schema"}'),
)
_IN = lambda term, n: f"CASE WHEN contains(hay, '{term}') THEN {n} ELSE 0 END"
_URGENT = " + ".join([_IN("status: f", 2), _IN("1-urgent", 4), _IN("total 5-low", 2), _IN("1-urgent", 4), _IN("status", 2), _IN("urgent", 2), _IN("orders", 2)])


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS j FROM orders), p AS (SELECT *, lag('PRIORITY: ' || o_orderpriority, 1, CASE WHEN o_custkey < 1000 THEN '# Customer ' || o_custkey ELSE '' END) OVER (PARTITION BY o_custkey ORDER BY j) AS above FROM o),
u AS (SELECT DISTINCT o_custkey AS doc_id, 0 AS idx, 'L1-L1' AS anchor, '# Customer ' || o_custkey AS text, CASE WHEN o_custkey < 1000 THEN '# Customer ' || o_custkey ELSE '' END AS heading FROM o
 UNION ALL SELECT o_custkey, 1 + 3 * j, 'L' || (3 + 6 * j) || '-L' || (3 + 6 * j), '- order ' || o_orderkey, above FROM p
 UNION ALL SELECT o_custkey, 2 + 3 * j, 'L' || (4 + 6 * j) || '-L' || (6 + 6 * j), 'STATUS: ' || o_orderstatus || chr(10) || 'TOTAL: ' || CAST(floor(o_totalprice) AS BIGINT) || chr(10) || 'DATE: ' || strftime(o_orderdate, '%Y-%m-%d'), 'STATUS: ' || o_orderstatus FROM p
 UNION ALL SELECT o_custkey, 3 + 3 * j, 'L' || (7 + 6 * j) || '-L' || (7 + 6 * j), 'PRIORITY: ' || o_orderpriority, 'PRIORITY: ' || o_orderpriority FROM p),
h AS (SELECT *, lower(heading || chr(10) || text) AS hay FROM u), n AS (SELECT *, min(CASE WHEN contains(hay, 'priority: 1-urgent') THEN idx END) OVER (PARTITION BY doc_id) AS start FROM h),
extra AS (SELECT *, CASE WHEN regexp_matches(text, '^- ') THEN 0.4 ELSE 0 END + CASE heading WHEN '' THEN 0 ELSE 0.3 END AS e, CASE WHEN regexp_matches(text, '\\b[0-9]+([.,][0-9]+)?\\b') THEN 0.8 ELSE 0 END AS f FROM n),
c AS (SELECT 'urgent' AS request_id, doc_id, 'scored' AS way, round({_URGENT} + e + f, 4)::DOUBLE AS score, -round({_URGENT} + e + f, 4)::DOUBLE AS first, idx, anchor, text, 420 AS most, 12 AS many FROM extra
 UNION ALL SELECT 'look', doc_id, 'overview', 0.2, 1, idx, anchor, text, 1400, 4 FROM extra WHERE idx < 3
 UNION ALL SELECT 'section', doc_id, 'section', round(CASE WHEN idx = start THEN 8 ELSE greatest(1, 7 - 0.4 * (idx - start)) END, 4), 0, idx, anchor, text, 300, 12 FROM extra WHERE idx BETWEEN start AND start + 9
 UNION ALL SELECT 'section', doc_id, 'scored', s, -s, idx, anchor, text, 300, 12 FROM (SELECT *, round({" + ".join([_IN("priority: 1-urgent", 2), _IN("the", 2), _IN("section", 2), _IN("urgent", 2), _IN("orders", 2)])} + e + f, 4)::DOUBLE AS s FROM extra WHERE start IS NULL)
 UNION ALL SELECT 'nothing', doc_id, 'scored', round({_IN("zzz", 2)} + {_IN("customer date", 2)} + e, 4), -round({_IN("zzz", 2)} + {_IN("customer date", 2)} + e, 4), idx, anchor, text, 200, 12 FROM extra WHERE e > 0),
r AS (SELECT *, length(anchor) + length(text) + 32 AS cost, row_number() OVER (PARTITION BY request_id, doc_id ORDER BY first, idx) AS k, count(*) OVER (PARTITION BY request_id, doc_id) AS n_candidates FROM c),
fold AS (SELECT request_id, doc_id, way, n_candidates, k, cost AS used, 1 AS taken, false AS over, anchor || '=' || CAST(score AS DECIMAL(10, 4)) AS blocks, text AS said FROM r WHERE k = 1
 UNION ALL SELECT f.request_id, f.doc_id, f.way, f.n_candidates, r.k, CASE WHEN ok THEN f.used + r.cost ELSE f.used END, CASE WHEN ok THEN f.taken + 1 ELSE f.taken END, f.over OR (f.way = 'section' AND f.used + r.cost > most), CASE WHEN ok THEN f.blocks || ' ' || r.anchor || '=' || CAST(r.score AS DECIMAL(10, 4)) ELSE f.blocks END, CASE WHEN ok THEN f.said || chr(10) || r.text ELSE f.said END
 FROM fold f JOIN r ON r.request_id = f.request_id AND r.doc_id = f.doc_id AND r.k = f.k + 1, LATERAL (SELECT f.used < most AND f.taken < many AND NOT f.over AND f.used + r.cost <= most AS ok) o),
last AS (SELECT *, lower(said) AS low FROM fold WHERE k = n_candidates)
SELECT request_id, doc_id, way, n_candidates, blocks, CASE request_id WHEN 'urgent' THEN concat_ws('|', CASE WHEN contains(low, 'status:') AND true THEN NULL ELSE 'STATUS: F' END, CASE WHEN contains(low, '1-urgent') THEN NULL ELSE '1-URGENT' END, CASE WHEN contains(low, 'total') AND contains(low, '5-low') THEN NULL ELSE 'total 5-LOW' END)
 WHEN 'section' THEN CASE WHEN contains(low, 'priority:') AND contains(low, '1-urgent') THEN '' ELSE 'PRIORITY: 1-URGENT' END WHEN 'nothing' THEN concat_ws('|', 'zzz', CASE WHEN contains(low, 'customer') AND contains(low, 'date') THEN NULL ELSE 'customer date' END) ELSE '' END AS open FROM last""")
def document_reads(s, d):
    docs = tables.rendered_orders(tables.table(s, d, "orders"))
    kinds = s.createDataFrame(list(READS), "request_id string, mode string, budget int, request string")
    got = reading.read_texts(docs, docs.select("doc_id").join(F.broadcast(kinds)))  # a few kinds of requests for each document
    said = F.transform("blocks", lambda b: F.concat_ws("=", b["anchor"], b["score"].cast("decimal(10,4)").cast("string")))
    return got.select("request_id", "doc_id", "way", "n_candidates", F.array_join(said, " ").alias("blocks"), F.array_join("open", "|").alias("open"))
