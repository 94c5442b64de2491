"""Deduplicating new batches against all history (problem 3): multi-key sorted-neighbourhood runs.

``History`` keeps what was accepted so far as runs in the shared folder, listed in a manifest that any later session
opens. A run has

* ``keys``: a row per sort key of each record (the segment keys of ``sketches`` and the content hash), in key buckets, sorted
  by key, with the number of the run's records that share the key;
* ``accepted``: (id, day, row_id, sizes and sketches) of the accepted classes of equal texts, in buckets by id;
* ``members``: (id, job_id) of these, in buckets by id;
* the signatures as they were written; their words are read for candidates only.

``absorb`` takes the next batch:

1. sign only the batch's rows, and give copies of one text on one day one node;
2. write the batch's keys as sorted buckets of a new run and merge them with the same buckets of the batch itself and of
   each older run: no row of the history is moved. Windows are the records of an equal key around a new record (keys
   are hashes, so neighbours with other keys are unrelated). Of a batch with up to ``FEW_KEYS`` keys, only the
   buckets that hold one of them are opened;
3. compare inside windows, exactly, as problem 5 does;
4. decide, earlier days first: a node with an accepted alike node of an earlier day is a case, any other is accepted.
   A batch may span many days; the decisions then take as many rounds as the longest chain of alike nodes;
5. name the run in a new manifest. ``FAN`` runs of a level are merged to one of the next, keys of cases left out, and deleted.

Defined results: rows with null ``first_seen`` or without words belong to no batch; null hashes give no hash key; rows
with repeated ``job_id`` count once; days must come in ascending order over calls; an empty batch changes nothing.
A batch that breaks off leaves a folder that no manifest names; absorbing it again is safe.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocandra.llm.lines import frequent_lines
from vocandra.llm.near_dup import BIT_COLUMNS, HOT_KEY, SIZES, key_table, near_of, one_per_class, verified
from vocandra.llm.sketches import common_words, signatures
from vocandra.session import broadcast_if_small, bucketed, is_small, listed, marked, open_bucketed, put_text, read_text, release, remove, shared_dir, stage, unstage

#: Runs of one level kept side by side before they are merged.
FAN = 4
#: Days taken into one call when a whole table is caught up.
SLICE_DAYS = 45
#: Distinct keys up to which a batch opens only the buckets of its keys, by a list in the filter.
FEW_KEYS = 4096
#: Bits of one bitmap, where many are sent.
MARKS = 1 << 20

PARTS = {
    "keys": ("key", "key BIGINT, id BIGINT, sharing BIGINT"),
    "accepted": ("id", "id BIGINT, day DATE, row_id BIGINT, n INT, " + ", ".join(f"{c} BIGINT" for c in BIT_COLUMNS)),
    "members": ("id", "id BIGINT, job_id BIGINT"),
}


def _together(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


class History:
    """Accepted records as sorted runs under ``path`` (a new folder in the shared one unless given); opens what is there."""

    def __init__(self, spark: SparkSession, path: str | None = None, fan: int = FAN, buckets: int | None = None, hot_key: int = HOT_KEY) -> None:
        self.spark, self.fan, self.hot_key = spark, fan, hot_key
        self.path = path or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
        self.number, self.runs = 0, []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        manifests = [m for m in listed(spark, self.path) if m.startswith("manifest-") and m.endswith(".json")]
        if manifests:
            state = json.loads(read_text(spark, f"{self.path}/{manifests[-1]}"))
            self.number, self.runs, self.buckets = state["number"], state["runs"], state["buckets"]
        self._open: dict[tuple[str, str], DataFrame] = {}

    def _read(self, run: dict, part: str) -> DataFrame:
        at = (run["name"], part)
        if at not in self._open:
            key, schema = PARTS[part]
            self._open[at] = open_bucketed(self.spark, f"{self.path}/{run['name']}/{part}", schema, key, self.buckets)
        return self._open[at]

    def _all(self, part: str) -> DataFrame:
        return _together([self._read(run, part) for run in self.runs])

    def _write(self, rows: DataFrame, run: str, part: str) -> None:
        key = PARTS[part][0]
        bucketed(rows.repartition(self.buckets, key), f"{self.path}/{run}/{part}", key, self.buckets)

    def _switch(self, runs: list[dict]) -> None:
        """The new list of runs takes effect as a whole."""
        state = {"number": self.number + 1, "buckets": self.buckets, "runs": runs}
        put_text(self.spark, f"{self.path}/manifest-{self.number + 1:09d}.json", json.dumps(state))
        if self.number:
            remove(self.spark, f"{self.path}/manifest-{self.number:09d}.json")
        self.number, self.runs = state["number"], runs

    def compact(self, level: int | None = None) -> None:
        """Merges the runs of a level (of all levels by default) to one run of the next."""
        old = [r for r in self.runs if level is None or r["level"] == level]
        if len(old) < 2:
            return
        run = {"name": f"run-{uuid.uuid4().hex}", "level": max(r["level"] for r in old) + 1, "signed": [s for r in old for s in r["signed"]]}
        parts = {part: _together([self._read(r, part) for r in old]) for part in PARTS}
        for part in ("accepted", "members"):
            self._write(parts[part], run["name"], part)
        kept = parts["keys"].select("key", "id").join(parts["accepted"].select("id"), "id", "left_semi")
        key_table(kept, f"{self.path}/{run['name']}/keys", alone=True, buckets=self.buckets)
        self._switch([r for r in self.runs if r not in old] + [run])
        for r in old:  # their signatures are the new run's
            for part in PARTS:
                remove(self.spark, f"{self.path}/{r['name']}/{part}")

    def absorb(self, batch: DataFrame) -> DataFrame:
        """batch: signatures with ``day``. Returns (job_id_a, job_id_b): each case with each accepted job it repeats."""
        name = f"run-{uuid.uuid4().hex}"
        signed_at = f"{name}/signed"
        batch.filter(F.col("day").isNotNull()).write.parquet(f"{self.path}/{signed_at}")
        rows = self.spark.read.schema(batch.schema).parquet(f"{self.path}/{signed_at}")
        leads = one_per_class(rows)
        keys = key_table(leads.select(F.explode("keys").alias("key"), "id"), f"{self.path}/{name}/keys", alone=True, buckets=self.buckets)
        nodes = stage(rows.select(F.col("class_id").alias("id"), "day").distinct(), "batch-nodes")
        sizes = leads.select(*SIZES)
        few = self._few(leads)

        # Candidates: the windows of the new records in the batch itself and in each run.
        old_sizes = self._windows("accepted", few)
        staged_sizes = stage(sizes if old_sizes is None else sizes.unionByName(old_sizes.select(*SIZES).join(nodes.select("id").distinct(), "id", "left_anti")), "batch-sizes")
        shared = keys.filter("sharing > 1")
        meets = [(shared, shared, True)]
        for run in self.runs:
            window = self._read(run, "keys")
            meets.append((keys, window.filter(F.col("key").isin(few)) if few is not None else window, False))
        release(self.spark)
        near = near_of(meets, staged_sizes, self.hot_key)
        words = leads.select("id", "words")
        if self.runs:
            used = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct().join(nodes.select("id"), "id", "left_anti")
            used = stage(self._all("accepted").join(broadcast_if_small(stage(used, "old-near"), 4 << 20), "id", "left_semi").select("id", "row_id"), "old-words")
            old_rows = _together([self.spark.read.parquet(f"{self.path}/{s}").select(F.col("class_id").alias("id"), "row_id", "words") for r in self.runs for s in r["signed"]])
            if not is_small(used, 4 << 20):  # the join shuffles; bitmaps of hashes leave it few rows that aren't asked for
                place = f"pmod(xxhash64(id, row_id), {16 * used.count()})"
                old_rows = marked(old_rows, used, f"{place} div {MARKS}", f"{place} % {MARKS}")
            words = words.unionByName(old_rows.join(broadcast_if_small(used, 4 << 20), ["id", "row_id"], "left_semi").select("id", "words").dropDuplicates(["id"]))
        alike = stage(verified(near, words), "batch-alike")

        # Edges from later to earlier nodes, whose days are the batch's or an accepted record's.
        itself = nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).distinct()
        both = stage(alike.union(alike.select("b", "a")).union(itself), "batch-links")
        days = nodes.withColumn("settled", F.lit(False))
        if self.runs:
            met = broadcast_if_small(stage(both.select(F.col("b").alias("id")).distinct(), "batch-met"), 4 << 20)
            days = days.unionByName(self._all("accepted").join(met, "id", "left_semi").select("id", "day", F.lit(True).alias("settled")))
        late = nodes.select(F.col("id").alias("a"), F.col("day").alias("day_a"))
        early = days.select(F.col("id").alias("b"), F.col("day").alias("day_b"), "settled")
        edges = both.join(late, "a").join(early, "b").filter("day_b < day_a")
        edges = stage(edges.select(F.struct(F.col("a").alias("id"), F.col("day_a").alias("day")).alias("late"), F.struct(F.col("b").alias("id"), F.col("day_b").alias("day")).alias("early"), "settled"), "batch-edges")
        cases = self._decide(edges)

        found = edges.join(cases, "late", "left_semi").join(cases.select(F.col("late").alias("early")), "early", "left_anti")
        found = stage(found.select("late", "early", "settled"), "batch-found")
        members = stage(rows.select(F.col("class_id").alias("id"), "day", "job_id").distinct(), "batch-members")
        node = F.struct("id", "day")
        i = members.select(node.alias("late"), F.col("job_id").alias("i"))
        j = members.select(node.alias("early"), F.col("job_id").alias("j"))
        out = found.filter("NOT settled").join(i, "late").join(j, "early").select("i", "j")
        if self.runs:
            met = found.filter("settled").join(i, "late").select(F.col("early.id").alias("id"), "i")
            out = out.union(met.join(self._all("members"), "id").select("i", F.col("job_id").alias("j")))
        out = stage(out.select(F.least("i", "j").alias("job_id_a"), F.greatest("i", "j").alias("job_id_b")), "batch-cases")

        accepted = nodes.join(cases.select("late.id", "late.day"), ["id", "day"], "left_anti")
        self._write(accepted.join(leads.select("row_id", *SIZES), "id").select("id", "day", "row_id", *SIZES[1:]), name, "accepted")
        self._write(members.join(accepted, ["id", "day"], "left_semi").select("id", "job_id"), name, "members")
        self._switch([*self.runs, {"name": name, "level": 0, "signed": [signed_at]}])
        unstage(nodes, staged_sizes, near, alike, both, edges, found, members)
        level = 0
        while len([r for r in self.runs if r["level"] == level]) >= self.fan:
            self.compact(level)
            level += 1
        return out

    def _few(self, leads: DataFrame) -> list[int] | None:
        """The batch's keys, where they are few."""
        few = leads.select(F.explode("keys").alias("key")).distinct().limit(FEW_KEYS + 1).collect() if self.runs else []
        return [r["key"] for r in few] if len(few) <= FEW_KEYS else None

    def _windows(self, part: str, few: list[int] | None) -> DataFrame | None:
        """Rows of ``part`` of the runs; of the records inside the windows only, where the batch has few keys."""
        if not self.runs:
            return None
        if few is None:
            return self._all(part)
        ids = _together([self._read(r, "keys").filter(F.col("key").isin(few)).select("id") for r in self.runs]).distinct().limit(FEW_KEYS + 1).collect()
        return self._all(part).filter(F.col("id").isin([r["id"] for r in ids])) if len(ids) <= FEW_KEYS else self._all(part)

    def _decide(self, edges: DataFrame) -> DataFrame:
        """(late,): the nodes that are cases."""
        cases = stage(edges.filter("settled").select("late").distinct(), "batch-decided")
        open_edges = edges.filter("not settled").select("late", "early").distinct()
        while True:
            open_edges = open_edges.join(cases, "late", "left_anti").join(cases.select(F.col("late").alias("early")), "early", "left_anti")
            open_edges = stage(open_edges.select("late", "early"), "batch-open")
            if open_edges.isEmpty():
                return cases
            waiting = open_edges.select(F.col("late").alias("early")).distinct()
            fresh = open_edges.join(waiting, "early", "left_anti").select("late").distinct()
            cases = stage(cases.union(fresh), "batch-decided")


def signed_batch(jobs: DataFrame, frequent: DataFrame | None = None, common: set[str] | None = None) -> DataFrame:
    """Signatures of a batch with ``day`` and the content hash among the keys."""
    signed = signatures(jobs, frequent, carry=("first_seen", "content_hash"), common=common)
    by_hash = F.xxhash64(F.lit("content"), F.substring(F.regexp_replace(F.lower("content_hash"), "[^0-9a-f]", ""), 1, 32))
    has_hash = F.col("lead") & (F.length(F.trim("content_hash")) > 0)
    signed = signed.withColumn("keys", F.when(has_hash, F.array_union("keys", F.array(by_hash))).otherwise(F.col("keys")))
    return signed.withColumn("day", F.to_date("first_seen")).drop("first_seen", "content_hash", "part")


def repeats_in_arrival_order(jobs: DataFrame, slice_days: int = SLICE_DAYS, history: History | None = None) -> DataFrame:
    """(job_id_a, job_id_b) of a whole table, its days taken up in slices as they came.

    The repeated lines that don't count are those of the whole table, as the definition of alike asks.
    """
    history = history or History(jobs.sparkSession)
    span = jobs.agg(F.to_date(F.min("first_seen")), F.to_date(F.max("first_seen"))).first()
    if span[0] is None:
        return jobs.select(F.col("job_id").alias("job_id_a"), F.col("job_id").alias("job_id_b")).limit(0)
    frequent, common = frequent_lines(jobs), common_words(jobs)
    number = F.floor(F.datediff(F.to_date("first_seen"), F.lit(span[0])) / slice_days).cast("int")
    out = []
    for k in range((span[1] - span[0]).days // slice_days + 1):
        out.append(history.absorb(signed_batch(jobs.filter(number == k), frequent, common)))
        release(jobs.sparkSession)
    return _together(out)
