"""Writers at the edge: reports, keyed tables, the run log."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocandra.session import listed, put_text, read_text, remove

#: A byte order mark before the first header makes spreadsheets read utf-8.
MARK = "﻿"


def write_report(rows: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """A csv report in order, written by the executors with a header and the mark; lists joined with '; '."""
    shown = rows.orderBy(*order) if order else rows
    columns = [F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in shown.dtypes]
    shown = shown.select(*columns)
    first = shown.columns[0]
    shown.withColumnRenamed(first, MARK + first).write.mode("overwrite").option("header", True).csv(path)


class KeyedTable:
    """A parquet table of versions under ``path``, found again by any later session.

    A small file names each version; it appears when the version is whole, and the highest number counts. The version
    before the newest is kept for readers that opened it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[str]:
        return [n for n in listed(self.spark, self.path) if n.startswith("version-") and n.endswith(".txt")]

    def read(self) -> DataFrame | None:
        named = self._versions()
        return self.spark.read.parquet(f"{self.path}/{read_text(self.spark, f'{self.path}/{named[-1]}')}") if named else None

    def write(self, rows: DataFrame) -> DataFrame:
        fresh = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{fresh}")
        named = self._versions()
        number = int(named[-1][8:-4]) + 1 if named else 1
        put_text(self.spark, f"{self.path}/version-{number:09d}.txt", fresh)
        for old in named[:-1]:
            remove(self.spark, f"{self.path}/{read_text(self.spark, f'{self.path}/{old}')}")
            remove(self.spark, f"{self.path}/{old}")
        return self.read()

    def put(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows with known keys replaced, others added."""
        old = self.read()
        return self.write(rows if old is None else old.join(rows.select(*keys), keys, "left_anti").unionByName(rows))

    def add_missing(self, rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
        """Rows with new keys added; of several with one key the first, by ``order`` or as they come."""
        order = F.monotonically_increasing_id() if order is None else order
        rows = rows.withColumn("_order", order).groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), "_order").alias("r")).select("r.*")
        old = self.read()
        return self.write(rows if old is None else old.unionByName(rows.join(old.select(*keys), keys, "left_anti")))


def cached(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows found in the cache with its columns, rows still to be computed)."""
    return rows.join(cache, key), rows.join(cache.select(key), key, "left_anti")


class RunLog:
    """Runs of the pipeline, one row each, in a keyed table: (id, started_at, finished_at, settings_json, stats_json, status)."""

    SCHEMA = "id long, started_at timestamp, finished_at timestamp, settings_json string, stats_json string, status string"

    def __init__(self, table: KeyedTable) -> None:
        self.table = table

    def start(self, settings: dict) -> int:
        """The id of a new run; its status is running."""
        old = self.table.read()
        number = (0 if old is None else old.agg(F.max("id")).first()[0] or 0) + 1
        row = self.table.spark.createDataFrame([(number, datetime.now(timezone.utc), None, json.dumps(settings), None, "running")], self.SCHEMA)
        self.table.put(row, ["id"])
        return number

    def finish(self, number: int, stats: dict, status: str = "finished") -> None:
        this = F.col("id") == number
        values = {"finished_at": F.current_timestamp(), "stats_json": F.lit(json.dumps(stats, default=str)), "status": F.lit(status)}
        self.table.write(self.table.read().withColumns({c: F.when(this, v).otherwise(F.col(c)) for c, v in values.items()}).select(*RUN_COLUMNS))


RUN_COLUMNS = [c.split()[0] for c in RunLog.SCHEMA.split(", ")]


def as_documents(rows: DataFrame, key: str, name: str = "document") -> DataFrame:
    """(key, document): all other columns of a row as one JSON object, nulls kept."""
    others = [c for c in rows.columns if c != key]
    return rows.select(key, F.to_json(F.struct(*others), {"ignoreNullFields": "false"}).alias(name))


def from_documents(documents: DataFrame, key: str, schema: str, defaults: dict | None = None, name: str = "document") -> DataFrame:
    """The columns of ``schema`` out of JSON objects; missing and unreadable ones take their default."""
    parsed = documents.select(key, F.from_json(name, schema).alias("d")).select(key, "d.*")
    return parsed.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (defaults or {}).items()}).select(key, *[c for c in parsed.columns if c != key])


def valid_in_cache(rows: DataFrame, cache: DataFrame, key: str, same: list[str]) -> tuple[DataFrame, DataFrame]:
    """As ``cached``, but an entry counts only where it was made from the same ``same`` columns (hashes of content, settings)."""
    held = cache.select(key, *[F.col(c).alias(f"_{c}") for c in same], *[c for c in cache.columns if c not in (key, *same)])
    agree = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
    met = rows.join(held, key)
    for condition in agree:
        met = met.filter(condition)
    met = met.drop(*[f"_{c}" for c in same])
    return met, rows.join(met.select(key), key, "left_anti")
