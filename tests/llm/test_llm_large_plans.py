"""The plans of tables whose ids are too many to be sent."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from vocandra import session
from vocandra.llm import history, near_dup
from vocandra.llm.sketches import signatures

SCHEMA = "job_id long, title string, company string, description string, source string, first_seen timestamp, content_hash string"


@pytest.fixture
def large(spark, monkeypatch):
    """Ids and sketches count as large, bitmaps don't."""
    for module in (near_dup, history):
        monkeypatch.setattr(module, "is_small", lambda *_: False, raising=False)
        monkeypatch.setattr(module, "broadcast_if_small", lambda df, *_: df if hasattr(df, "staged_at") else session.stage(df, "side"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _jobs(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    rows = []
    for k, g in itertools.product(range(4), range(12)):
        text = words[g * 40 : g * 40 + 40]
        text[k] = f"edit{k}"
        rows.append((k * 12 + g, "t", "c", " ".join(text), f"s{g}", f"2025-0{1 + 2 * (k // 2)}-{10 + 9 * k // 2} 10:00:00", ""))
    rows = spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string"))
    return rows.withColumn("first_seen", F.to_timestamp("first_seen"))


def test_signed_rows_are_not_shuffled(spark, large):
    signed = session.stage(signatures(_jobs(spark)), "signed")
    leads = near_dup.one_per_class(signed)
    plan = leads._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted(r["id"] for r in leads.collect()) == sorted(r["class_id"] for r in signed.select("class_id").distinct().collect())


def test_large_plans_find_the_same(spark, large):
    want = {(a * 12 + g, b * 12 + g) for g in range(12) for a, b in itertools.combinations(range(4), 2)}
    assert {tuple(r) for r in near_dup.alike_pairs(_jobs(spark)).collect()} == want
    got = {tuple(r) for r in history.repeats_in_arrival_order(_jobs(spark)).collect()}
    assert got == {(g, b * 12 + g) for g in range(12) for b in range(1, 4)}


def test_pairs_in_rounds(spark, monkeypatch):
    """Every key has its round."""
    signed = session.stage(signatures(_jobs(spark)), "signed")
    leads = near_dup.one_per_class(signed)
    keys = near_dup.key_table(leads.select(F.explode("keys").alias("key"), "id"))
    sizes = session.stage(leads.select(*near_dup.SIZES), "sizes")
    whole = {tuple(r) for r in near_dup.near_of([(keys, keys, True)], sizes).collect()}
    monkeypatch.setattr(near_dup, "is_small", lambda *_: False)
    rounds = near_dup.near_of([(keys, keys, True)], sizes, at_once=1)
    assert whole and {tuple(r) for r in rounds.collect()} == whole and rounds.count() == len(whole)


def test_marked(spark):
    rows = spark.range(100_000).withColumn("row_id", F.expr("id % 3 * 8589934592 + id"))
    wanted = rows.filter("id % 777 = 5")
    got = session.marked(rows, wanted, near_dup.TASK, near_dup.PLACE)
    assert sorted(r["id"] for r in got.collect()) == [i for i in range(100_000) if i % 777 == 5]
