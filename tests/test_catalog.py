"""Every registered query against its SQL over whole tables."""

import math
import os

import duckdb
import pytest

from gleaner.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value if isinstance(value, (int, str, type(None))) else str(value)


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = ordered(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(catalog.ORACLE_SQL[name])
    want = ordered(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_episodes_cover_all_events(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    out = catalog.QUERIES["episode_batch"](spark, SF)
    rows = sorted((r.ts, r.event_id, r.user_id, r.event_type) for r in events.collect())
    want, ep, state = {}, {}, {}
    for _, _, user, kind in rows:
        before = state.get(user, "open")
        ep[user] = ep.get(user, 0) + (kind == "signup")
        state[user] = "open" if kind in ("signup", "error") else "ready" if kind == "purchase" else before
        n, late, _ = want.get((user, ep[user]), (0, 0, ""))
        want[user, ep[user]] = (n + 1, late + (before == "ready" and kind not in ("signup", "error", "purchase")), state[user])
    assert {(r.user_id, r.episode): (r.n_events, r.n_after_ready, r.state) for r in out.collect()} == want
