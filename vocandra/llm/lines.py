"""Lines repeated across one site's documents (problem 6).

A line's key is its letters in order, lower-cased; everything else is ignored. Distinct documents
are counted per (source, key) and per (company, key); a key is frequent in a scope from
``MIN_DOCS`` documents and ``MIN_SHARE`` of all the scope's documents on. The frequent keys are joined back to the
documents, whose lines can be flagged (``repeated_lines``) or cut (``without_repeated_lines``).

Defined results: a null or empty description has no lines to flag; a line without letters never counts;
a null or blank company is no scope; a null source is a scope of its own; repeated job rows count one
document per distinct ``job_id``; an empty table gives empty results; other columns are ignored.

At scale: keys are made distinct inside each row before the shuffle, counts are combined map-side, so a
source holding a third of all rows costs one counter per key and task. A scope has at most
1/MIN_SHARE times its documents' mean line count of frequent keys, so the joined side stays small; it is broadcast only
after counting, otherwise the join shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocandra.session import broadcast_if_small, is_small, stage

MIN_DOCS = 8
MIN_SHARE = 0.05
#: xxhash64 of the empty string, the hash of every line without letters.
NO_LETTERS = -7444071767201028348
#: Stands for the scope of a blank company; a null would turn the column's hashes into floats.
NO_SCOPE = 0


def line_hashes(text: Column) -> Column:
    """One hash per line, ``NO_LETTERS`` where the line has no letters. One pass of the pattern per text."""
    letters = F.regexp_replace(F.lower(text), r"[^\p{L}\n]+", "")
    return F.transform(F.split(letters, "\n", -1), lambda line: F.xxhash64(line))


def scope_hash(kind: str, value: Column) -> Column:
    return F.xxhash64(F.lit(kind), value)


def scopes(jobs: DataFrame) -> tuple[Column, Column]:
    """Ids of the scopes a row belongs to: its source, and its company value (null where blank)."""
    has_company = F.length(F.trim(jobs["company"])) > 0
    return scope_hash("source", jobs["source"]), F.when(has_company, scope_hash("company", jobs["company"]))


def frequent_lines(jobs: DataFrame) -> DataFrame:
    """(scope, line): the hashes of the lines that are frequent in a scope; staged."""
    in_scopes = F.array_compact(F.array(*scopes(jobs)))
    rows = jobs.select(
        "job_id",
        in_scopes.alias("scopes"),
        F.array_remove(F.array_distinct(line_hashes(F.col("description"))), NO_LETTERS).alias("lines"),
    )
    # Rows of one job_id count once. They are few, if any: only their own lines are made distinct by a shuffle.
    again = broadcast_if_small(stage(jobs.groupBy("job_id").count().filter("count > 1").select("job_id"), "repeated-jobs"))
    once, more = rows.join(again, "job_id", "left_anti"), rows.join(again, "job_id", "left_semi")

    def of_jobs(exploded: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return exploded(once).union(exploded(more.select("job_id", "scopes", "lines")).distinct()).drop("job_id")

    sizes = of_jobs(lambda r: r.select("job_id", F.explode("scopes").alias("scope"))).groupBy("scope").count().withColumnRenamed("count", "docs")
    sizes = sizes.filter(F.col("docs") >= MIN_DOCS)
    lines = of_jobs(lambda r: r.select("job_id", F.explode("lines").alias("line"), "scopes").select("job_id", "line", F.explode("scopes").alias("scope")))
    counts = lines.groupBy("scope", "line").count().filter(F.col("count") >= MIN_DOCS)
    kept = counts.join(sizes, "scope").filter(F.col("count") >= MIN_SHARE * F.col("docs"))
    return stage(kept.select("scope", "line"), "frequent-lines")


def repeated_lines(jobs: DataFrame, frequent: DataFrame | None = None) -> DataFrame:
    """(job_id, line_no): every line of every job that is frequent in the job's source or company."""
    frequent = frequent_lines(jobs) if frequent is None else frequent
    source, company = scopes(jobs)
    lines = jobs.select(
        "job_id", source.alias("by_source"), company.alias("by_company"), F.posexplode(line_hashes(F.col("description"))).alias("at", "line")
    ).filter(F.col("line") != NO_LETTERS)
    small = is_small(frequent)
    for scope in ("by_source", "by_company"):
        hits = frequent.select(F.col("scope").alias(scope), "line", F.lit(True).alias(f"{scope}_hit"))
        lines = lines.join(F.broadcast(hits) if small else hits, [scope, "line"], "left")
    hits = lines.filter(F.col("by_source_hit") | F.col("by_company_hit"))
    return hits.select("job_id", (F.col("at") + 1).alias("line_no")).distinct()


def without_repeated_lines(jobs: DataFrame) -> DataFrame:
    """(job_id, description): the descriptions rebuilt without their frequent lines; null stays null.

    The frequent hashes of a row's two scopes come to it as two arrays, so texts are cut in place and never shuffled
    where the scopes' arrays are small; a scope has at most 1/MIN_SHARE times its mean line count of them.
    """
    source, company = scopes(jobs)
    packed = stage(frequent_lines(jobs).groupBy("scope").agg(F.collect_list("line").alias("wanted")), "wanted-lines")
    rows = jobs.select("job_id", "description", source.alias("by_source"), company.alias("by_company"))
    for scope in ("by_source", "by_company"):
        rows = rows.join(broadcast_if_small(packed).select(F.col("scope").alias(scope), F.col("wanted").alias(f"{scope}_wanted")), scope, "left")
    none = F.array().cast("array<bigint>")
    wanted = F.array_union(F.coalesce("by_source_wanted", none), F.coalesce("by_company_wanted", none))
    lines = F.arrays_zip(F.split("description", "\n", -1).alias("text"), line_hashes(F.col("description")).alias("line"))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("wanted"), x["line"]))
    return rows.withColumn("wanted", wanted).select("job_id", F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("description"))
