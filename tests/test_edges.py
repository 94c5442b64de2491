from __future__ import annotations

import glob

from pyspark.sql import functions as F

import __spark_entry__
from vocandra.sources.files import call_plan, config_hash, merged_config, profile_documents, resumes, scraped
from vocandra.sources.sinks import KeyedTable, cached, write_report
from vocandra.streaming.arrivals import event_windows, first_arrivals, upsert_batches

RAW = "raw_id long, site string, title string, company string, job_url string, location string, description string, date_posted string, job_type array<string>, min_amount double, max_amount double, currency string, pay_interval string, is_remote boolean, job_level string, experience_range string, scraped_at timestamp_ntz"


def test_resumes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Ann Lee\r\n\r\n\r\n\r\n" + "word " * 20)
    (tmp_path / "b.md").write_text("short")
    (tmp_path / "c.xyz").write_text("x")
    got = {r["path"][-5:]: r for r in resumes(spark, str(tmp_path)).collect()}
    assert got["a.txt"]["text"].startswith("Ann Lee\n\nword") and got["a.txt"]["problem"] is None
    assert got["/b.md"]["problem"] == "too short" and "unknown" in got["c.xyz"]["problem"]


def test_profile_documents(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"name":\n "A"}')
    assert profile_documents(spark, str(tmp_path)).first()["profile_json"].startswith("{")


def test_scraped_names(spark):
    frame = spark.createDataFrame([("", "http://x/1", "T", float("nan"))], "JOB_URL string, link string, job_title string, min_amount double")
    row = scraped(frame).first()
    assert (row["job_url"], row["title"], row["min_amount"], row["company"]) == ("http://x/1", "T", None, None)


def test_settings():
    assert merged_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 5, "x": 9}, "y": 1}) == {"a": {"b": 5, "c": 2}}
    assert config_hash({"a": 1, "b": 2}) == config_hash({"b": 2, "a": 1})


def test_call_plan(spark):
    assert [tuple(r) for r in call_plan(spark, ["p", "q"], ["x", "y"], 3).collect()] == [(1, "p", "x"), (2, "p", "y"), (3, "q", "x")]


def test_report_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([(2, ["a", "b"]), (1, None)], "job_id long, sources array<string>")
    write_report(rows, str(tmp_path / "r"), [F.col("job_id")])
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(str(tmp_path / "r" / "part*"))))
    assert text.startswith("﻿job_id") and "a; b" in text
    store = KeyedTable(spark, f"file://{tmp_path}/t")
    assert store.read() is None
    store.put(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), ["k"])
    store.put(spark.createDataFrame([(2, "c")], "k long, v string"), ["k"])
    store.add_missing(spark.createDataFrame([(2, "z"), (3, "d")], "k long, v string"), ["k"])
    assert {tuple(r) for r in store.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}
    hit, miss = cached(spark.createDataFrame([(1,), (9,)], "k long"), store.read(), "k")
    assert hit.count() == 1 and miss.first()["k"] == 9


def test_streams(spark, tmp_path):
    raw = [(i, "s", "T", "A", f"https://x.org/{i % 3}?utm=1", "L", "d" * (i + 1), None, None, None, None, None, None, None, None, None, None) for i in range(6)]
    frame = spark.createDataFrame(raw, RAW).withColumn("scraped_at", F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00'"))
    frame.withColumn("title", F.concat("title", F.col("raw_id").cast("string"))).repartition(2).write.parquet(str(tmp_path / "in"))
    store = KeyedTable(spark, f"file://{tmp_path}/jobs")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream.writeStream.foreachBatch(upsert_batches(store)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r["url"] for r in store.read().collect()} == {f"https://x.org/{k}" for k in range(3)}
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (1, "2024-01-01 01:10:00", "b", 4.0)], "event_id long, ts string, event_type string, value double")
    assert {(r["event_type"], r["events"], r["total"]) for r in event_windows(events).collect()} == {("a", 2, 3.0), ("b", 1, 4.0)}
    assert first_arrivals(events, "event_id", "ts").count() == 2


def test_entry_lists_every_oracle():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
