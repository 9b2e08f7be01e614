"""The queries that SQL can express, against their SQL."""

import os

import duckdb
import pytest
from gleaner.llm import queries

SF = os.environ.get("GLEANER_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.execute(queries.ORACLE_SQL[name]).fetchdf()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, got[columns].values.tolist())) == sorted(map(repr, want[columns].values.tolist()))


def test_sql_of_written_texts():
    """The SQL itself on rows whose answers are known."""
    db = duckdb.connect()
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(1, "Password: 'abcdef' token=abc"), (2, None), (3, long), (4, "x " + long + " y"), (5, long.upper()), (6, "")]
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    spans = dict(db.execute(f"SELECT doc_id, spans FROM ({queries.ORACLE_SQL['op7_secrets']})").fetchall())
    assert spans[1] == "assign:0:17" and not any(spans[i] for i in range(2, 7))
    removed = dict(db.execute(f"SELECT doc_id, n_removed FROM ({queries.ORACLE_SQL['op8_substring_dedup']})").fetchall())
    assert removed == {1: 0, 2: 0, 3: 0, 4: 20, 5: 0, 6: 0}
    groups = {r[0]: r[1:] for r in db.execute(f"SELECT doc_id, n_shingles, component_id FROM ({queries.ORACLE_SQL['op1_jaccard_join']})").fetchall()}
    assert groups == {1: (1, 1), 2: (0, 2), 3: (17, 3), 4: (19, 3), 5: (17, 3), 6: (0, 6)}
