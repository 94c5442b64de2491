"""Vectors: a hashing embedder, cosine, top lists, rescaling, weighted scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocandra.operators.skills import runs
from vocandra.session import broadcast_if_small, stage

DIMENSIONS = 256
#: Bytes of query vectors that go over all items at once.
BLOCK_BYTES = 4 << 20


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, normalised or not; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def hashed_grams(texts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """texts: (key, text). (key, bucket, weight): sparse unit vectors of character trigrams, hashed by md5."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "))
    grams = texts.select("key", clean.alias("t")).filter(F.length("t") >= 3)
    grams = grams.select("key", F.explode(runs(F.filter(F.split("t", ""), lambda c: c != ""), 3, "")[2]).alias("gram"))
    counted = grams.groupBy("key", "gram").count()
    bucket = F.pmod(F.conv(F.substr(F.md5("gram"), F.lit(1), F.lit(8)), 16, 10).cast("bigint"), F.lit(dimensions)).cast("int")
    sums = counted.groupBy("key", bucket.alias("bucket")).agg(F.sum("count").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy("key")))
    return sums.select("key", "bucket", (F.col("n") / length).alias("weight"))


#: Embedders by name: functions of (key, text) to (key, vector).
EMBEDDERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def embed(texts: DataFrame, name: str = "hashing", fallback: bool = False) -> DataFrame:
    """(key, vector) by a registered embedder; names that start with hashing, and others with ``fallback``, hash trigrams."""
    if name in EMBEDDERS:
        return EMBEDDERS[name](texts)
    if name.startswith("hashing") or fallback:
        return dense(hashed_grams(texts))
    raise KeyError(f"no embedder is registered as {name}")


def register_batches(name: str, encode: Callable[[list[str]], np.ndarray]) -> None:
    """Registers a model that turns lists of texts into matrices; it runs on Arrow batches in the workers."""

    def over(texts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = unit(np.asarray(encode([t or "" for t in batch.column(1).to_pylist()]), float)) if batch.num_rows else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float64()))], ["key", "vector"])

        return texts.select(F.col("key").cast("long").alias("key"), "text").mapInArrow(run, "key long, vector array<double>")

    EMBEDDERS[name] = over


def similarity(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query, key, similarity) of sparse vectors; queries: (query, bucket, weight), broadcast only where few."""
    met = items.join(broadcast_if_small(queries.withColumnRenamed("weight", "w")), "bucket")
    return met.groupBy("query", "key").agg(F.sum(F.col("w") * F.col("weight")).alias("similarity"))


def top(rows: DataFrame, by: list[str], score: str, tie: str, k: int, least: float | None = None) -> DataFrame:
    """The best ``k`` per group of at least ``least``; limited inside each task before the shuffle."""
    rows = rows if least is None else rows.filter(F.col(score) >= least)
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), tie))
    return rows.withColumn("place", place).filter(F.col("place") <= k)


def search(items: DataFrame, queries: DataFrame, k: int, block: int = BLOCK_BYTES, digits: int | None = None) -> DataFrame:
    """(query, key, similarity): the ``k`` items of highest cosine per query, smaller keys first; both are (key, vector).

    The queries go over all items in blocks of at most ``block`` bytes of numbers: a block is a matrix that is broadcast, and
    each batch of items takes one product with it and hands on its own best k per query. So the shuffle holds k rows per
    query and task, and no item is copied. ``digits``: similarities are rounded before they are compared.
    """
    spark = items.sparkSession
    keyed = stage(queries.select(F.col("key").alias("query"), F.col("vector").cast("array<double>").alias("v")), "queries")
    size = keyed.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-size[0] * (size[1] or 1) * 8 // block))
    schema = "query long, key long, similarity double"
    found = []
    for number in range(blocks):
        part = keyed.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number).toArrow()
        if not part.num_rows:
            continue
        sent = spark.sparkContext.broadcast((part["query"].to_numpy(), unit(np.array(part["v"].to_pylist(), float))))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            # The best so far: at most k rows per query and task.
            held_keys, held = [np.zeros(0, np.int64)] * len(names), [np.zeros(0)] * len(names)
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(0).to_numpy()
                share = q @ unit(_matrix(batch.column(1), q.shape[1])).T
                share = share if digits is None else np.round(share, digits)
                least = np.partition(share, -k, axis=1)[:, -k] if share.shape[1] > k else np.full(len(names), -2.0)
                for i, row in enumerate(share):
                    at = np.flatnonzero(row >= max(least[i], held[i][-1] if len(held[i]) == k else -2.0))
                    both, score = np.concatenate([held_keys[i], keys[at]]), np.concatenate([held[i], row[at]])
                    order = np.lexsort((both, -score))[:k]
                    held_keys[i], held[i] = both[order], score[order]
            if len(names):
                columns = [np.repeat(names, [len(x) for x in held]), np.concatenate(held_keys), np.concatenate(held)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "key", "similarity"])

        found.append(items.select("key", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(best, schema))
    if not found:
        return spark.createDataFrame([], schema)
    return top(reduce(DataFrame.union, found), ["query"], "similarity", "key", k).select("query", "key", "similarity")


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix; null and shorter vectors are filled with zeros."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)
    out = np.zeros((len(lists), width))
    for i, row in enumerate(lists.to_pylist()):
        row = (row or [])[:width]
        out[i, : len(row)] = [x or 0.0 for x in row]
    return out


def dense(sparse: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, vector) of sparse vectors (key, bucket, weight): a group has one row per dimension at most."""
    packed = sparse.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("at"))
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    return packed.select("key", F.transform(places, lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0.0))).alias("vector"))


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1.0)


def rescale(c: Column, floor: float, ceiling: float) -> Column:
    """floor to 0, ceiling to 100; 50 where there is no range."""
    if ceiling <= floor:
        return F.lit(50.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (c - floor) / (ceiling - floor)))


def weighted(parts: dict[str, float]) -> Column:
    """Weighted mean of columns; a missing one counts 0."""
    total = sum(parts.values())
    return sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in parts.items()), F.lit(0.0)) / total
