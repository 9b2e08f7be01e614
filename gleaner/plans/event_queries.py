"""Queries over event streams in their batch form, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables
from ..streaming import episodes, ready, sinks
from .registry import query


def _events(s: SparkSession, d: str) -> DataFrame:
    return tables.table(s, d, "events")


K = "CAST(json_extract_string(props, '$.k') AS INT)"
#: The events as reading events, numbered in each conversation.
READING = f"""raw AS (SELECT *, {K} AS k FROM events),
ev AS (SELECT CAST(user_id AS VARCHAR) AS conversation, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
 CASE WHEN event_type IN ('view', 'click') THEN 'bind' WHEN event_type = 'purchase' THEN 'ready' WHEN event_type = 'error' THEN ['read', 'output', 'read'][k % 3 + 1] ELSE ['final', 'end', 'final', 'other'][k % 4 + 1] END AS kind,
 't' || (event_id // 500) AS turn, ['/r/a', '/r/b'][k % 2 + 1] || ['', '/x', '', '/x/y'][(k // 2) % 4 + 1] AS scope,
 coalesce(['continue', 'unknown', 'continue', 'new', NULL, 'switch', 'continue'][(k // 3) % 7 + 1], '') AS relation, coalesce(['unknown', 'selective_read', NULL, 'selective_read'][(k // 5) % 4 + 1], '') AS goal,
 ['unknown', 'targeted', 'targeted'][(k // 7) % 3 + 1] AS coverage, 's' || k AS summary, ['collection_goal_required', 'long_document'][k % 2 + 1] AS code, 'c' || k AS closure FROM raw)"""
EPISODES = f"""WITH RECURSIVE {READING},
fold AS (SELECT conversation, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS event_id, '' AS kind, false AS rotated, CAST(0 AS BIGINT) AS number, 'none' AS status, '' AS turn, '' AS scope, '' AS goal, '' AS coverage, '' AS summary, '' AS code, '' AS closure, CAST(0 AS BIGINT) AS late_reads
  FROM (SELECT DISTINCT conversation FROM ev)
 UNION ALL SELECT e.conversation, e.n, e.event_id, e.kind, fresh, f.number + CAST(fresh AS BIGINT),
  CASE WHEN fresh OR news THEN 'open' WHEN wakes THEN CASE f.closure WHEN '' THEN 'open' ELSE 'evidence_ready' END WHEN e.kind = 'bind' OR f.status = 'none' THEN f.status WHEN e.kind = 'ready' AND rel THEN 'evidence_ready'
   WHEN e.kind = 'final' OR (e.kind = 'output' AND f.status = 'evidence_ready') THEN 'resolved' WHEN e.kind = 'end' THEN 'none' ELSE f.status END,
  CASE WHEN fresh OR (kept AND e.turn <> '') THEN e.turn WHEN e.kind = 'end' THEN '' ELSE f.turn END,
  CASE WHEN fresh THEN e.scope WHEN e.kind = 'end' THEN '' ELSE f.scope END,
  CASE WHEN fresh AND e.goal = '' THEN 'unknown' WHEN fresh OR (kept AND g) THEN e.goal WHEN e.kind = 'end' THEN '' ELSE f.goal END,
  CASE WHEN fresh AND e.coverage = '' THEN 'unknown' WHEN fresh OR (kept AND c) THEN e.coverage WHEN e.kind = 'end' THEN '' ELSE f.coverage END,
  CASE WHEN fresh OR (e.summary <> '' AND (wakes OR news)) THEN e.summary WHEN e.kind = 'end' THEN '' ELSE f.summary END,
  CASE WHEN fresh OR news THEN e.code WHEN e.kind = 'end' THEN '' ELSE f.code END,
  CASE WHEN fresh OR news OR e.kind = 'end' THEN '' WHEN e.kind = 'ready' AND rel AND f.status <> 'none' THEN e.closure ELSE f.closure END,
  f.late_reads + CAST(e.kind = 'read' AND f.status = 'evidence_ready' AS BIGINT)
 FROM fold f JOIN ev e ON e.conversation = f.conversation AND e.n = f.n + 1,
 LATERAL (SELECT f.scope = e.scope OR starts_with(e.scope, f.scope || '/') OR starts_with(f.scope, e.scope || '/') AS rel, e.goal NOT IN ('', 'unknown', f.goal) AS g, e.coverage NOT IN ('', 'unknown', f.coverage) AS c) r,
 LATERAL (SELECT f.status <> 'none' AND rel AND CASE f.status WHEN 'resolved' THEN e.relation = 'continue' ELSE NOT (e.relation = 'switch' OR (e.relation = 'new' AND e.turn <> f.turn)
  OR (f.status = 'open' AND f.code = 'collection_goal_required' AND e.scope <> f.scope AND starts_with(e.scope, f.scope || '/'))) END AS stays) s,
 LATERAL (SELECT e.kind = 'bind' AND NOT stays AS fresh, e.kind = 'bind' AND stays AS kept, e.kind = 'bind' AND stays AND (g OR c) AS news, e.kind = 'bind' AND stays AND f.status = 'resolved' AS wakes) t)"""


@query(f"""{EPISODES} SELECT conversation, event_id, kind, rotated, CASE number WHEN 0 THEN '' ELSE 'episode_' || substr(sha1(conversation || '|' || number), 1, 10) END AS episode_id,
 number, status, turn, scope, goal, coverage, summary, code, closure, late_reads FROM fold WHERE n > 0""")
def reading_episodes(s, d):
    return episodes.folded(episodes.rendered(_events(s, d))).drop("ts")


#: An age and a number of entries that the table's conversations go beyond.
TTL, MOST = 3 * ready.DAY, 3


@query(f"""WITH RECURSIVE raw AS (SELECT *, {K} AS k FROM events),
ev AS (SELECT CAST(user_id AS VARCHAR) AS conversation, event_id, epoch_us(ts) AS at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, '/r' || (k % 3) || CASE k % 2 WHEN 0 THEN '' ELSE '/d' || (k % 5) END AS path,
 CASE event_type WHEN 'view' THEN 'ask' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'put' WHEN 'signup' THEN CASE k % 2 WHEN 0 THEN 'ask' ELSE 'put' END ELSE CASE k % 7 WHEN 0 THEN 'drop' ELSE 'ask' END END AS kind FROM raw),
fold AS (SELECT conversation, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS event_id, '' AS kind, '' AS path, CAST(NULL AS BOOLEAN) AS granted, CAST(NULL AS VARCHAR) AS answer,
  CAST([] AS STRUCT(p VARCHAR, t BIGINT)[]) AS puts, CAST([] AS STRUCT(p VARCHAR, t BIGINT)[]) AS claims FROM (SELECT DISTINCT conversation FROM ev)
 UNION ALL SELECT e.conversation, e.n, e.event_id, e.kind, e.path, CASE e.kind WHEN 'put' THEN true WHEN 'claim' THEN free END,
  CASE WHEN e.kind = 'ask' THEN list_sort(list_transform(list_filter(lp, lambda x: x.p = e.path OR starts_with(e.path, x.p || '/')), lambda x: x.p), 'DESC')[1] END,
  CASE e.kind WHEN 'put' THEN list_append(list_filter(lp, lambda x: x.p <> e.path), {{'p': e.path, 't': e.at}})[-{MOST}:] WHEN 'drop' THEN list_filter(lp, lambda x: NOT (x.p = e.path OR starts_with(x.p, e.path || '/') OR starts_with(e.path, x.p || '/'))) ELSE lp END,
  CASE WHEN e.kind = 'claim' AND free THEN list_append(lc, {{'p': e.path, 't': e.at}})[-{MOST}:] ELSE lc END
 FROM fold f JOIN ev e ON e.conversation = f.conversation AND e.n = f.n + 1,
 LATERAL (SELECT list_filter(f.puts, lambda x: e.at - x.t < {TTL}) AS lp, list_filter(f.claims, lambda x: e.at - x.t < {TTL}) AS lc) l, LATERAL (SELECT len(list_filter(lc, lambda x: x.p = e.path)) = 0 AS free) o)
SELECT conversation, event_id, kind, path, granted, answer, len(puts) AS held FROM fold WHERE n > 0""")
def ready_cache(s, d):
    return ready.folded(ready.rendered(_events(s, d)), TTL, MOST)


@query(f"""WITH raw AS (SELECT CAST(user_id AS VARCHAR) AS conversation, event_type AS t, {K} AS k FROM events),
e AS (SELECT conversation, k, CASE t WHEN 'purchase' THEN 'usage' WHEN 'error' THEN 'native' WHEN 'signup' THEN 'card' WHEN 'view' THEN CASE k % 2 WHEN 0 THEN 'preview' ELSE 'raw' END ELSE 'read' END AS kind FROM raw)
SELECT conversation, CAST(coalesce(sum(CASE k % 3 WHEN 0 THEN k WHEN 1 THEN k + 7 ELSE 5 END) FILTER (kind = 'usage'), 0) AS BIGINT) AS tokens, count(*) FILTER (kind = 'usage') AS requests,
 count(*) FILTER (kind IN ('preview', 'raw', 'card', 'read') OR (kind = 'native' AND k % 2 = 0)) AS tool_calls, count(*) FILTER (kind = 'native' AND k % 5 = 0) AS truncations, count(*) FILTER (kind = 'preview') AS previews,
 count(*) FILTER (kind = 'raw') AS raws, count(*) FILTER (kind = 'card') AS cards, count(*) FILTER (kind = 'read') AS reads, count(*) FILTER (kind = 'native' AND k % 4 = 0) > 0 AS written FROM e GROUP BY conversation""")
def session_summary(s, d):
    return sinks.session_summary(sinks.rendered(_events(s, d)))
