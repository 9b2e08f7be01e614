"""What a task holds does not grow with the table: queries over rendered tables run in partitions of so many rows."""

import re

import pytest

from gleaner.plans.catalog import QUERIES
from gleaner.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["slot_collect", "json_scalars", "unit_scores", "unresolved_evidence"])
def test_partitions_grow_with_the_table(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "SPREAD_ROWS", 100)
    assert tables.table(spark, SF, "orders").count() > 1_200
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= 12


def test_batches_are_cut_by_bytes(monkeypatch):
    """Python strings are made of a slice at a time, whatever a batch holds; a long text is a slice of its own."""
    import pyarrow as pa

    from gleaner.operators import batches

    monkeypatch.setattr(batches, "SLICE_BYTES", 10)
    texts = ["abcd", None, "", "é" * 4, "x" * 50, "a", "b", "c" * 9, ""]
    batch = pa.RecordBatch.from_pydict({"id": list(range(9)), "t": texts})
    got = [b.to_pydict() for b in batches.slices(iter([batch.slice(0, 0), batch, batch.slice(3, 2)]), "t")]
    assert [b["id"] for b in got] == [[0, 1, 2], [3], [4], [5, 6], [7, 8], [3], [4]]
    assert [t for b in got[:5] for t in b["t"]] == texts


@pytest.mark.parametrize("module", ["denoise", "items"])
def test_texts_are_read_in_slices(spark, tmp_path, module):
    """A batch of many texts goes through in several pieces with all its rows."""
    import importlib

    from gleaner.operators import batches

    done = getattr(importlib.import_module(f"gleaner.operators.{module}"), {"denoise": "denoised", "items": "items"}[module])
    rows = [(i, ("line %d\n" % i) * 9_000) for i in range(200)]
    assert sum(len(t) for _, t in rows) > 3 * batches.SLICE_BYTES
    got = done(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(r.doc_id for r in got) == list(range(200))


def test_requests_of_a_file_of_one_block_are_many_tasks(spark, monkeypatch):
    from gleaner.operators import requests

    monkeypatch.setattr(tables, "SPREAD_ROWS", 10)
    part = tables.table(spark, SF, "part")
    assert requests.rendered(part).rdd.getNumPartitions() == -(-part.count() // 10) > 4


def test_answers_read_the_orders_once(spark):
    """Texts that lie by customer give all slots' answers, those of lists as well, without a second reading, shuffle or join."""
    plan = QUERIES["typed_answers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan
    assert len(re.findall(r"\bExchange\b", plan)) == 1
