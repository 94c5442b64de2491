"""Near-duplicate records with small edits (problem 5): a parity-sketch join.

1. ``signatures``: parity sketches of every job's words (see ``sketches``), written once.
2. Jobs with the same multiset of words are one class; only one row of a class goes on, so a third of all rows being copies
   of one text costs a row per task from here on.
3. Pigeonhole join: classes that share a segment key are candidates. Keys go to buckets once (``key_table``); everything by
   key happens inside a bucket. A key shared by more than ``HOT_KEY`` classes isn't dropped: its classes are cut into
   blocks, every block meets every block, and the bound of step 4 is applied there, before anything is shuffled.
4. Hamming distance of the 512-bit sketches, a lower bound of the symmetric difference, rejects most candidates.
5. The exact multiset overlap of the rest decides.

``alike_classes`` gives one row per job (class, links); ``alike_pairs`` all pairs of jobs, copies expanded, as the
table of cases asks.

Defined results: null or blank descriptions are in no pair; null title or company count as empty; a job whose words
are all in repeated lines has none and is in no pair; repeated ``job_id`` rows count once; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocandra.llm.sketches import BITS, THRESHOLD, signatures
from vocandra.session import broadcast_if_small, bucketed, is_small, marked, release, shared_dir, stage, unstage

#: Representatives that share a segment key from which on their pairs are made in blocks, under the sketch bound.
HOT_KEY = 128
#: Ids of a hot key in a block: a task takes block by block of pairs, and each id goes to as many as its key has blocks.
BLOCK = 4096
BIT_COLUMNS = [f"bits{i}" for i in range(BITS // 64)]
SIZES = ["id", "n", *BIT_COLUMNS]
#: Bytes of a file of sizes and sketches up to which it is sent to the executors.
SENT_SIZES = 24 << 20
#: Where they aren't, pairs are shuffled to their sketches: pairs of a round, whose shuffle files go before the next, and rounds at most.
ROUND, ROUNDS = 8_000_000, 4
#: Task and place of a signed row.
TASK, PLACE = "shiftright(row_id, 33)", "row_id & 8589934591"


def _bound(threshold: float, bits: list[str]) -> Column:
    """Whether a and b (n and the columns ``bits``, with _a and _b) can reach the threshold, by their sizes and sketches."""
    total = F.col("n_a") + F.col("n_b")
    far = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in bits), F.lit(0))
    return (2 * F.least("n_a", "n_b") >= threshold * total) & (far <= (1 - threshold) * total)


def _bits(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c.startswith("bits")]


def _side(frame: DataFrame, name: str) -> DataFrame:
    return frame.select(*[F.col(c).alias(name if c == "id" else f"{c}_{name}") for c in frame.columns])


def one_per_class(signed: DataFrame) -> DataFrame:
    """Of staged signatures, one row with keys and words per class, as ``id``."""
    first = signed.filter("lead").groupBy("class_id").agg(F.min("row_id").alias("row_id")).select("row_id")
    return marked(signed, first, TASK, PLACE).withColumnRenamed("class_id", "id")


def key_table(rows: DataFrame, path: str | None = None, alone: bool = False, buckets: int | None = None) -> DataFrame:
    """(key, id, sharing), bucketed and sorted by key, of rows (key, id); sharing: the ids that have the key.

    Keys that only one id has are left out unless ``alone``. A table under ``path`` (the shared folder's by default).
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.repartition(buckets, "key").withColumn("sharing", F.count("*").over(W.partitionBy("key")))
    path = path or f"{shared_dir(spark)}/keys-{uuid.uuid4().hex}"
    out = bucketed(counted if alone else counted.filter("sharing > 1"), path, "key", buckets)
    out.staged_at, out.buckets = path, buckets
    return out


def met_pairs(left: DataFrame, right: DataFrame, sizes: DataFrame, same: bool, hot_key: int = HOT_KEY, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: ids of two tables (key, id, sharing) that share a key; see step 3. May have repeated rows.

    same: both are one table. sizes: (id, n, bits) of all ids.
    """
    plain = lambda frame, x: frame.filter(F.col("sharing") <= hot_key).select("key", F.col("id").alias(x))
    met = plain(left, "a").join(plain(right, "b"), "key").filter("a < b" if same else "a <> b")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # Hot on either side: the few keys are found by a filter that skips row groups without any.
    hot = left.filter(F.col("sharing") > hot_key).select("key")
    hot = stage((hot if same else hot.union(right.filter(F.col("sharing") > hot_key).select("key"))).distinct(), "hot-keys")
    if hot.isEmpty():
        return met
    hot = broadcast_if_small(hot, 1 << 20)
    asking, asked = left.join(hot, "key", "left_semi"), right.join(hot, "key", "left_semi")
    blocks = lambda of: F.ceil(F.col(of) / block).cast("int")
    counts = asking.groupBy("key").agg(F.max("sharing").alias("of_a")).join(asked.groupBy("key").agg(F.max("sharing").alias("of_b")), "key")
    counts = counts.select("key", blocks("of_a").alias("rows"), blocks("of_b").alias("columns"))
    asking, asked = (frame.drop("sharing").join(counts, "key").join(sizes, "id") for frame in (asking, asked))
    asking = asking.withColumn("i", F.pmod(F.xxhash64("id"), "rows").cast("int"))
    asked = asked.withColumn("j", F.pmod(F.xxhash64("id"), "columns").cast("int"))
    # Of one table both sides have the same blocks, and those at or above the diagonal are enough.
    asking = asking.withColumn("j", F.explode(F.sequence(F.col("i") if same else F.lit(0), F.col("columns") - 1)))
    asked = asked.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j") if same else F.col("rows") - 1)))
    asking, asked = (_side(frame.drop("rows", "columns"), x).withColumnsRenamed({f"{c}_{x}": c for c in ("key", "i", "j")}) for frame, x in ((asking, "a"), (asked, "b")))
    once = F.expr("a < b OR (i < j AND a <> b)" if same else "a <> b")
    near = asking.join(asked, ["key", "i", "j"]).filter(once & _bound(threshold, _bits(sizes))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.union(near)


def candidate_pairs(keyed: DataFrame, signed: DataFrame, hot_key: int = HOT_KEY, by_new: bool = False, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: ids of ``keyed`` (id, keys), once each, that share a key and are within the bound. ``signed`` has their n and bits.

    by_new: ``keyed`` has a flag ``new`` as well, and only pairs with a new id on at least one side are made.
    """
    sizes = stage(signed.select("id", "n", *_bits(signed)), "sizes")
    tables = [keyed.filter("new"), keyed.filter("NOT new")] if by_new else [keyed]
    tables = [key_table(t.select(F.explode("keys").alias("key"), "id"), alone=by_new) for t in tables]
    meets = [(tables[0], tables[0], True)] + ([(tables[0], tables[1], False)] if by_new else [])
    return near_of(meets, sizes, hot_key, threshold, block)


def near_of(meets: list[tuple[DataFrame, DataFrame, bool]], sizes: DataFrame, hot_key: int = HOT_KEY, threshold: float = THRESHOLD, block: int = BLOCK, at_once: int = ROUND) -> DataFrame:
    """``near_pairs`` of the ``met_pairs`` of each (left, right, same), once each.

    Where the pairs must be shuffled to their sketches, they are made in rounds of keys, so that the disk holds the
    shuffle files of one round; every key has its round.
    """
    rounds = 1
    if not is_small(sizes, SENT_SIZES):
        made = sum(right.agg(F.sum(F.least("sharing", F.lit(hot_key)))).first()[0] or 0 for _, right, _ in meets)
        rounds = max(1, min(ROUNDS, math.ceil(made / at_once)))
    out = []
    for r in range(rounds):
        of = lambda t: t.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == r) if rounds > 1 else t  # noqa: B023, E731
        pairs = [met_pairs(of(left), of(right), sizes, same, hot_key, threshold, block) for left, right, same in meets]
        out.append(near_pairs(reduce(DataFrame.union, pairs), sizes, threshold))
        if rounds > 1:
            del pairs
            release(sizes.sparkSession)
    if rounds == 1:
        return out[0]
    near = stage(reduce(DataFrame.union, out).distinct(), "near-pairs")
    unstage(*out)
    return near


def near_pairs(pairs: DataFrame, sizes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The distinct pairs (a, b) that can reach the threshold by the bound. sizes: staged (id, n, bits), once each.

    Where the sizes are small they are sent to the pairs, so that only the few pairs within the bound are shuffled.
    """
    small = is_small(sizes, SENT_SIZES)
    sent = F.broadcast(sizes) if small else sizes
    pairs = pairs if small else pairs.distinct()
    near = pairs.join(_side(sent, "a"), "a").join(_side(sent, "b"), "b").filter(_bound(threshold, _bits(sizes))).select("a", "b")
    return stage(near.distinct() if small else near, "near-pairs")


def verified(near: DataFrame, words: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of staged pairs (a, b), those that reach the threshold. words: (id, words), once each; with ``row_id``, of one signed table."""
    used = stage(near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct(), "near-ids")
    if "row_id" in words.columns and not is_small(used, 4 << 20):
        words = marked(words, words.select("id", "row_id").join(used, "id", "left_semi"), TASK, PLACE).select("id", "words")
    else:
        words = words.select("id", "words").join(broadcast_if_small(used, 4 << 20), "id", "left_semi")
    full = near.join(_side(words, "a"), "a").join(_side(words, "b"), "b")

    def overlap(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right):
                both = np.concatenate([np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)])
                both.sort()
                out.append(2.0 * np.count_nonzero(both[1:] == both[:-1]) / len(both))
            yield pd.Series(out, dtype="float64")

    share = F.pandas_udf(overlap, "double")
    return full.withColumn("share", share("words_a", "words_b")).filter(F.col("share") >= threshold).select("a", "b")


def _linked(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(job_id, class_id) of all jobs with words, and the alike pairs (a, b) of class ids."""
    signed = stage(signatures(jobs), "signatures")
    leads = one_per_class(signed)
    keys = key_table(leads.select(F.explode("keys").alias("key"), "id"))
    sizes = stage(leads.select(*SIZES), "sizes")
    release(jobs.sparkSession)
    near = near_of([(keys, keys, True)], sizes)
    links = stage(verified(near, leads), "alike-classes")
    member = stage(signed.select("job_id", "class_id").distinct(), "members")
    unstage(signed, keys, sizes, near)
    return member, links


def within_classes(member: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, j), i < j: all pairs of jobs of one class. Large classes meet block by block, so no task has a whole one."""
    sizes = stage(member.groupBy("class_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("jobs")).filter("jobs > 1"), "class-sizes")
    shared = member.join(broadcast_if_small(sizes), "class_id").withColumn("own", F.pmod(F.xxhash64("job_id"), "blocks").cast("int"))
    left = shared.select("class_id", F.col("job_id").alias("i"), F.col("own").alias("x"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("y"))
    right = shared.select("class_id", F.col("job_id").alias("j"), F.col("own").alias("y"), F.explode(F.sequence(F.lit(0), "own")).alias("x"))
    met = left.join(right, ["class_id", "x", "y"]).filter("i < j OR (x < y AND i <> j)")
    return met.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))


def alike_pairs(jobs: DataFrame) -> DataFrame:
    """(job_id_a, job_id_b), job_id_a < job_id_b: all pairs of jobs that are alike."""
    member, links = _linked(jobs)
    left, right = (member.select(F.col("job_id").alias(j), F.col("class_id").alias(c)) for j, c in (("i", "a"), ("j", "b")))
    across = links.join(left, "a").join(right, "b").select(F.least("i", "j").alias("job_id_a"), F.greatest("i", "j").alias("job_id_b"))
    return across.union(within_classes(member).select(F.col("i").alias("job_id_a"), F.col("j").alias("job_id_b")))


def alike_classes(jobs: DataFrame) -> DataFrame:
    """(job_id, class_id, copies, links): one row per job with words; links counts the jobs of other classes it is alike to.

    class_id is the smallest job_id of the class.
    """
    member, links = _linked(jobs)
    sizes = member.groupBy("class_id").agg(F.count("*").alias("copies"), F.min("job_id").alias("first_id"))
    both = links.union(links.select("b", "a")).join(sizes.select(F.col("class_id").alias("b"), "copies"), "b")
    linked = both.groupBy(F.col("a").alias("class_id")).agg(F.sum("copies").alias("links"))
    per_class = sizes.join(linked, "class_id", "left").na.fill(0, ["links"])
    return member.join(per_class, "class_id").select("job_id", F.col("first_id").alias("class_id"), "copies", "links")
