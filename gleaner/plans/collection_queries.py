"""Queries over collections, files, tables and their routing, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collection, files, gate, rows
from ..operators.relevance import Request
from ..sources import tables
from .registry import query

ITEMS = """items AS (SELECT source AS collection, 'doc-' || doc_id || '.txt' AS name, lang AS subject, substr(text, 1, 260) AS about, doc_id FROM documents)"""
GOAL, NEEDLES = "Find all licensed releases and passwords", ["doc-1", "fr"]
_TERMS = ["licensed", "releases", "release", "passwords", "password", "doc-1"]
_HITS = " + ".join(f"CASE WHEN contains(head, '{t}') THEN 3.0 WHEN contains(rest, '{t}') THEN 1.5 ELSE 0 END" for t in _TERMS)
RANKS = f"""{ITEMS}, h AS (SELECT *, lower(concat_ws(chr(10), name, subject)) AS head, lower(about) AS rest FROM items), s AS (SELECT *, {_HITS} AS p FROM h), m AS (SELECT *, max(p) OVER (PARTITION BY collection) <= 0 AS none, row_number() OVER (PARTITION BY collection ORDER BY p DESC, name) AS rank FROM s),
ranks AS (SELECT collection, name, doc_id, CAST(rank AS INT) AS rank, CASE WHEN none THEN 0.1 ELSE p END::DOUBLE AS score FROM m WHERE rank <= 10 AND (p > 0 OR (none AND rank <= 8)))"""


def _items(s, d):
    docs = tables.table(s, d, "documents")
    return docs.select(F.col("source").alias("collection"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("lang").alias("subject"), F.substring("text", 1, 260).alias("about"), "doc_id")


def _asked(items):
    return items.select("collection").distinct().select(F.lit("r").alias("request_id"), "collection", F.lit(GOAL).alias("goal"), F.array(*[F.lit(n) for n in NEEDLES]).alias("needles"), F.array().cast("array<string>").alias("must_keep"))


@query(f"WITH {RANKS} SELECT collection, name, rank, score FROM ranks")
def collection_ranks(s, d):
    items = _items(s, d)
    return collection.ranked(items, _asked(items), 10).select("collection", "name", "rank", "score")


@query(f"WITH {RANKS} SELECT d.doc_id, sha256(text) AS text_sha256 FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM ranks WHERE rank <= 3)")
def chosen_texts(s, d):
    items = _items(s, d)
    best = collection.ranked(items, _asked(items), 3).select(F.regexp_extract("name", "([0-9]+)", 1).cast("long").alias("doc_id"))
    return collection.only(tables.table(s, d, "documents"), "doc_id", best).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH {ITEMS} SELECT collection, name FROM items WHERE contains('see doc-7.txt and doc-12.txt', name) OR contains('doc-40.txt', name)")
def named_items(s, d):
    items = _items(s, d)
    asked = items.select("collection").distinct().select(F.lit("r").alias("request_id"), "collection", F.array(F.lit("see doc-7.txt and doc-12.txt")).alias("needles"), F.array(F.lit("doc-40.txt"), F.lit("doc-40.txt"), F.lit(" ")).alias("must_keep"))
    return collection.named(items, asked).select("collection", "name")


FILES = """k AS (SELECT p_partkey AS k, CAST(p_size * 100 + (p_partkey % 5) * 1000 AS BIGINT) AS size FROM part),
files AS (SELECT size, CASE WHEN k % 11 = 0 THEN '/w/ReadMe' || k WHEN k % 13 = 0 THEN '/w/docs/x' || k || '/AGENTS.md' ELSE '/w/' || ['.git', 'docs', 'data', 'a', 'memory', 'Zed'][k % 6 + 1] || CASE k % 5 WHEN 0 THEN '/skills' WHEN 1 THEN '/deep' ELSE '' END || '/f' || k || ['.csv', '.md', '.py', '.bin', '', '.XML', '.log'][k % 7 + 1] END AS path FROM k)"""
ENDING = "lower(CASE WHEN contains(name, '.') THEN string_split(name, '.')[-1] ELSE '' END)"


def _files(s, d):
    k = F.col("p_partkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % n + 1).cast("int"))
    usual = F.concat(F.lit("/w/"), pick(6, ".git", "docs", "data", "a", "memory", "Zed"), F.when(k % 5 == 0, "/skills").when(k % 5 == 1, "/deep").otherwise(""), F.lit("/f"), k.cast("string"), pick(7, ".csv", ".md", ".py", ".bin", "", ".XML", ".log"))
    path = F.when(k % 11 == 0, F.concat(F.lit("/w/ReadMe"), k.cast("string"))).when(k % 13 == 0, F.concat(F.lit("/w/docs/x"), k.cast("string"), F.lit("/AGENTS.md"))).otherwise(usual)
    return tables.table(s, d, "part").select(path.alias("path"), (F.col("p_size") * 100 + (k % 5) * 1000).cast("long").alias("size"))


@query(f"""WITH {FILES}, n AS (SELECT *, string_split(path, '/')[-1] AS name FROM files), e AS (SELECT *, {ENDING} AS ending FROM n)
SELECT path, size, CASE ending WHEN 'py' THEN 'text' WHEN 'md' THEN 'text' WHEN 'log' THEN 'text' WHEN '' THEN 'text' ELSE ending END AS type, ending, ending IN ('csv', 'xml') AS structured, ending IN ('csv', 'md', 'py', 'xml', 'log') OR starts_with(lower(name), 'readme') AS supported,
 size >= CASE WHEN ending IN ('csv', 'xml') THEN 1024 ELSE 4096 END AS large FROM e""")
def detected_files(s, d):
    return files.detected(_files(s, d))


@query(f"""WITH {FILES}, n AS (SELECT *, string_split(path, '/') AS parts FROM files), e AS (SELECT *, parts[-1] AS name FROM n)
SELECT parts[3] AS folder, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes, count(*) >= 3 OR sum(size) >= 4096 AS large FROM e
WHERE len(parts) > 3 AND name <> 'AGENTS.md' AND {ENDING} IN ('csv', 'md', 'py', 'xml', 'log') AND NOT list_has_any(parts[3:len(parts) - 1], ['.git', 'memory', 'skills']) GROUP BY folder""")
def content_folders(s, d):
    return files.folders(_files(s, d), "/w")


@query(f"""WITH {FILES}, n AS (SELECT DISTINCT string_split(path, '/')[3] AS name, len(string_split(path, '/')) > 3 AS is_folder FROM files)
SELECT CAST(row_number() OVER (ORDER BY lower(name), name) AS INT) AS place, name, is_folder FROM n WHERE NOT starts_with(name, '.') ORDER BY lower(name), name LIMIT 24""")
def workspace_candidates(s, d):
    return files.candidates(_files(s, d), "/w/")


@query("""WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS r FROM l WHERE contains(lower(text), 'licen'))
SELECT doc_id, CAST(line AS INT) AS line, text FROM h WHERE r <= 200""")
def selected_lines(s, d):
    return files.raw_lines(tables.table(s, d, "documents"), "LICEN")


ROWS = Request("Find rows of Brand#13", ("cold", "ring"), ("p_size",), "fact")


@query("""WITH c AS (SELECT p_partkey, p_name, p_brand, p_size, lower('p_partkey=' || p_partkey || ' | p_name=' || p_name || ' | p_brand=' || p_brand || ' | p_type=' || p_type || ' | p_size=' || p_size) AS low FROM part),
s AS (SELECT p_partkey, 'p_size=' || p_size AS text, CASE WHEN contains(low, 'cold') THEN 2 ELSE 0 END + CASE WHEN contains(low, 'ring') THEN 2 ELSE 0 END + CASE WHEN contains(low, 'p_size') THEN 2 ELSE 0 END + CASE WHEN contains(low, 'rows') THEN 2 ELSE 0 END + CASE WHEN contains(low, 'brand') THEN 2 ELSE 0 END + 0.5 AS score, p_brand FROM c),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, p_partkey) AS k FROM s), t AS (SELECT 'p_brand=' || p_brand || ' | ' || text AS text, score, k FROM b WHERE k <= 40), u AS (SELECT text, min(k) AS k, any_value(score) AS score FROM t GROUP BY text)
SELECT CAST(row_number() OVER (ORDER BY k) AS INT) AS rank, text, score::DOUBLE AS score FROM u ORDER BY k LIMIT 8""")
def table_read(s, d):
    part = tables.table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return rows.read(part, ROWS, ["p_partkey"])


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INT) AS rank, 'n_nationkey=' || n_nationkey || ' | n_name=' || n_name || ' | n_regionkey=' || n_regionkey AS text, CAST(1 AS DOUBLE) AS score FROM nation")
def table_whole(s, d):
    return rows.read(tables.table(s, d, "nation"), Request("give all rows"), ["n_nationkey"], "scout")


@query(f"""WITH {FILES}, g AS (SELECT unnest(['selective_read', 'structured_compute', 'compute_or_edit', 'full_fidelity', 'what']) AS said, unnest(['', '', '', '', 'advisory']) AS override), n AS (SELECT *, string_split(path, '/')[-1] AS name FROM files), e AS (SELECT *, {ENDING} AS ending FROM n),
o AS (SELECT path, size, said, override, ending, CASE said WHEN 'compute_or_edit' THEN 'edit_or_execute' WHEN 'what' THEN 'unknown' ELSE said END AS goal, ending IN ('csv', 'xml') AS structured, ending IN ('py', 'md', 'log', '') AS is_text FROM e, g),
r AS (SELECT path, said, CASE WHEN NOT structured AND NOT is_text THEN 'native|unsupported|1.0' WHEN override <> '' THEN override || '|override|1.0' WHEN size < 500 THEN 'native|below_benefit_floor|0.95' WHEN ending = 'py' THEN 'native|native_code_or_config|0.95'
 WHEN goal IN ('full_fidelity', 'edit_or_execute') THEN 'native|native_' || goal || '|0.95' WHEN is_text AND size < 4096 THEN 'advisory|document_boundary|0.65' WHEN is_text AND goal = 'selective_read' THEN 'force|long_document_selective|0.9' WHEN is_text THEN 'force|long_document|0.82'
 WHEN goal = 'structured_compute' THEN 'native|native_single_table_compute|0.92' ELSE 'advisory|structured_targeted_only|0.7' END AS r FROM o)
SELECT path, said, split_part(r, '|', 1) AS mode, split_part(r, '|', 2) AS code, CAST(split_part(r, '|', 3) AS DOUBLE) AS confidence FROM r""")
def gate_files(s, d):
    told = files.detected(_files(s, d), 500)
    said = [("selective_read", ""), ("structured_compute", ""), ("compute_or_edit", ""), ("full_fidelity", ""), ("what", "advisory")]
    goals = F.explode(F.array(*[F.struct(F.lit(g).alias("said"), F.lit(o).alias("override")) for g, o in said]))
    found = told.withColumn("g", goals).select("*", "g.said", "g.override").withColumn("goal", gate.shaped(F.col("said")))
    return gate.objects(found, "path", "said")


@query("""WITH k AS (SELECT p_partkey // 12 AS c, p_partkey AS k, CAST(p_size * 100 AS BIGINT) AS size FROM part), f AS (SELECT c, size, ['csv', 'json', 'md', 'code', 'log', 'yaml', 'csv'][(k + c) % CASE c % 3 WHEN 0 THEN 7 WHEN 1 THEN 2 ELSE 5 END + 1] AS kind FROM k WHERE k % 12 < 2 + c % 11),
m AS (SELECT c, count(*) AS n, sum(size) AS b, count(*) FILTER (kind = 'md') AS t, count(*) FILTER (kind IN ('csv', 'json', 'yaml')) AS st, count(*) FILTER (kind = 'csv') AS tab, count(*) FILTER (kind = 'code') AS code, count(*) FILTER (kind = 'log') AS log, count(DISTINCT kind) AS kinds FROM f GROUP BY c),
g AS (SELECT *, unnest(['cross_file_evidence', 'cross_file_evidence', 'edit_or_execute', 'structured_compute', 'selective_read']) AS goal, unnest(['exhaustive', 'targeted', '', '', '']) AS coverage FROM m),
x AS (SELECT *, c % 17 = 0 AS pdf, n >= 5 AND st >= 3 AND b >= 20000 AND t + st + code >= 4 AS plan FROM g),
r AS (SELECT c, goal, coverage, CASE WHEN plan AND (goal = 'structured_compute' OR (goal = 'edit_or_execute' AND tab >= 3 AND st * 2 > n AND log = 0)) THEN 'force|structured_analysis_plan|0.88' WHEN goal = 'edit_or_execute' THEN 'native|native_edit_or_execute|0.95' WHEN goal = 'structured_compute' THEN 'native|native_small_structured_compute|0.9'
 WHEN pdf THEN 'force|collection_long_document|0.88' WHEN goal = 'cross_file_evidence' AND coverage = 'exhaustive' AND (n >= 10 OR b >= 40000) AND st <> n THEN 'advisory|broad_evidence_boundary|0.7'
 WHEN goal = 'cross_file_evidence' AND n >= 3 AND b >= 8192 AND st <> n AND t + st + code + log >= 3 THEN 'force|multi_file_evidence|0.9' WHEN goal = 'cross_file_evidence' THEN 'advisory|multi_file_evidence_boundary|0.68'
 WHEN t >= greatest(3, (n + 1) // 2) AND (b >= 24576 OR n >= 8) THEN 'advisory|large_text_collection_boundary|0.72' WHEN kinds > 1 OR b >= 8192 OR n >= 3 THEN 'advisory|collection_goal_required|0.62' ELSE 'native|small_collection|0.9' END AS r FROM x)
SELECT c AS collection, goal, coverage, split_part(r, '|', 1) AS mode, split_part(r, '|', 2) AS code, CAST(split_part(r, '|', 3) AS DOUBLE) AS confidence FROM r""")
def gate_collections(s, d):
    k = F.col("p_partkey")
    c = F.floor(k / 12)
    pick = lambda n: F.element_at(F.array(*[F.lit(x) for x in ("csv", "json", "md", "code", "log", "yaml", "csv")]), ((k + c) % n + 1).cast("int"))
    kind = F.when(c % 3 == 0, pick(7)).when(c % 3 == 1, pick(2)).otherwise(pick(5))
    found = tables.table(s, d, "part").where(k % 12 < 2 + c % 11).select(c.alias("collection"), kind.alias("kind"), (F.col("p_size") * 100).cast("long").alias("size"))
    asked = [("cross_file_evidence", "exhaustive"), ("cross_file_evidence", "targeted"), ("edit_or_execute", ""), ("structured_compute", ""), ("selective_read", "")]
    goals = F.explode(F.array(*[F.struct(F.lit(g).alias("goal"), F.lit(v).alias("coverage")) for g, v in asked]))
    stats = gate.measured(found, "collection").withColumn("long_pdf", F.col("collection") % 17 == 0).withColumn("g", goals).select("*", "g.goal", "g.coverage")
    return gate.collections(stats, "collection", "goal", "coverage")
