"""Scraped rows to postings: normalisation, order-dependent deduplication with merge, incremental upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocandra.functions import detect, text, web
from vocandra.session import stage

WINDOW_CHARS = 400


def filled(c: Column) -> Column:
    """Null for blank."""
    return F.when(F.length(F.trim(c)) > 0, c)


def normalise(raw: DataFrame) -> DataFrame:
    """One posting per scraped row that has an address and a title; a narrow projection without a shuffle."""
    clean = raw.withColumn("url", F.trim(F.coalesce(filled(F.col("job_url")), F.lit("")))).withColumn("title", F.trim(F.coalesce("title", F.lit(""))))
    clean = clean.filter("url <> '' AND title <> ''")
    clean = clean.withColumn("company", F.trim(F.coalesce("company", F.lit("")))).withColumn("location", F.trim(F.coalesce("location", F.lit(""))))
    clean = clean.withColumn("description", text.clean_description(F.col("description"))).withColumn("source", F.lower(F.trim(F.coalesce("site", F.lit("")))))
    start = F.substr("description", F.lit(1), F.lit(WINDOW_CHARS))
    stated = F.when(F.size("job_type") > 0, web.employment_of(F.col("job_type"))).otherwise("unknown")
    return clean.select(
        F.col("raw_id").alias("ordinal"),
        "company",
        "title",
        "location",
        "description",
        web.canonical_url(F.col("url")).alias("url"),
        "source",
        F.when(F.col("source") != "", F.array("source")).otherwise(F.array().cast("array<string>")).alias("sources"),
        web.pay_text(F.col("min_amount"), F.col("max_amount"), F.col("currency"), F.col("pay_interval")).alias("salary"),
        F.when(stated != "unknown", stated).otherwise(detect.employment_type(F.col("title"), start)).alias("employment_type"),
        detect.work_mode(F.when(F.col("is_remote"), "remote"), F.col("title"), F.col("location"), start).alias("work_mode"),
        web.parse_date(F.col("date_posted")).alias("posted_date"),
        text.content_hash(F.col("company"), F.col("title"), F.col("description")).alias("content_hash"),
        F.coalesce("job_level", F.lit("")).alias("job_level_raw"),
        F.coalesce("experience_range", F.lit("")).alias("experience_range_raw"),
    )


def with_keys(postings: DataFrame) -> DataFrame:
    """url_key, and fuzzy_key from company, title and location; the latter is never empty."""
    place = F.regexp_replace(F.lower(F.trim("location")), r"\s+", " ")
    fuzzy = F.concat_ws("|", text.company_key(F.col("company")), text.title_key(F.col("title")), place)
    return postings.withColumn("url_key", F.col("url")).withColumn("fuzzy_key", fuzzy)


def holders(keyed: DataFrame) -> DataFrame:
    """(ordinal, holder): the earliest-first rule. A row is kept unless a kept row holds one of its keys.

    Rows are edges between their two keys, and the rule is the greedy matching in input order. It is found in rounds:
    rows that come first for both of their keys are kept, all rows that share a key with them leave. Rounds needed are
    the longest chain of rows waiting for each other; each halves or better in practice, and works on what is left.
    """
    live = stage(keyed.select("ordinal", "url_key", "fuzzy_key"), "live")
    everything, kept = live, None
    while True:
        firsts = [live.groupBy(k).agg(F.min("ordinal").alias(f"first_{k}")) for k in ("url_key", "fuzzy_key")]
        now = live.join(firsts[0], "url_key").join(firsts[1], "fuzzy_key")
        now = stage(now.filter("ordinal = first_url_key AND ordinal = first_fuzzy_key").select("ordinal", "url_key", "fuzzy_key"), "kept")
        kept = now if kept is None else kept.union(now)
        left = live.join(now.select("url_key"), "url_key", "left_anti").join(now.select("fuzzy_key"), "fuzzy_key", "left_anti")
        live = stage(left.select("ordinal", "url_key", "fuzzy_key"), "live")
        if live.isEmpty():
            break
    by_url = kept.select("url_key", F.col("ordinal").alias("url_holder"))
    by_fuzzy = kept.select("fuzzy_key", F.col("ordinal").alias("fuzzy_holder"))
    held = everything.join(by_url, "url_key", "left").join(by_fuzzy, "fuzzy_key", "left")
    url_first = F.when(F.col("url_holder") <= F.col("ordinal"), F.col("url_holder"))
    return held.select("ordinal", F.coalesce(url_first, "fuzzy_holder").alias("holder"))


def first_by_order(value: Column, order: Column, when: Column) -> Column:
    """The value of the first row for which ``when`` holds; min_by never collects a group."""
    return F.min_by(value, F.when(when, order))


def deduplicate(postings: DataFrame) -> DataFrame:
    """Kept postings, each merged with the rows it holds.

    The longest description wins (the earlier of equals) with its hash; dates, pay, place and mode are the first known;
    sources are listed once in order. All but the sources are plain aggregates, combined before the shuffle; sources
    are reduced to one row per source first, so a group of any size stays small.
    """
    keyed = with_keys(postings)
    rows = keyed.join(holders(keyed), "ordinal")
    order = F.col("ordinal")
    known = lambda c: F.length(F.trim(c)) > 0
    longest = F.struct(F.length("description"), -order)
    merged = rows.groupBy("holder").agg(
        *[F.min_by(c, order).alias(c) for c in ("company", "title", "url", "source", "employment_type", "job_level_raw", "experience_range_raw")],
        F.max_by("description", longest).alias("description"),
        F.max_by("content_hash", longest).alias("content_hash"),
        first_by_order(F.col("posted_date"), order, F.col("posted_date").isNotNull()).alias("posted_date"),
        F.coalesce(first_by_order(F.col("salary"), order, known(F.col("salary"))), F.lit("")).alias("salary"),
        F.coalesce(first_by_order(F.col("location"), order, known(F.col("location"))), F.lit("")).alias("location"),
        F.coalesce(first_by_order(F.col("work_mode"), order, F.col("work_mode") != "unknown"), F.lit("unknown")).alias("work_mode"),
        F.count("*").alias("merged_rows"),
    )
    listed = rows.select("holder", "ordinal", F.posexplode("sources").alias("at", "name"))
    listed = listed.groupBy("holder", "name").agg(F.min(F.struct("ordinal", "at")).alias("first"))
    listed = listed.groupBy("holder").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]).alias("sources"))
    return merged.join(listed, "holder", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def upsert(old: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Old postings with new ones merged in by url: one full outer join on the key, no row is updated in place.

    Both have company, title, location, description, url, sources, salary, employment_type, work_mode, content_hash,
    first_seen, last_seen; urls are unique in each.
    """
    o, n = old.alias("o"), new.alias("n")
    met = o.join(n, F.col("o.url") == F.col("n.url"), "full_outer")
    has_new = F.col("n.url").isNotNull()
    newest = lambda c: F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    newest_filled = lambda c: F.coalesce(filled(F.col(f"n.{c}")), F.col(f"o.{c}"))
    empty = F.array().cast("array<string>")
    return met.select(
        F.coalesce("o.url", "n.url").alias("url"),
        *[newest(c).alias(c) for c in ("company", "title", "location")],
        *[newest_filled(c).alias(c) for c in ("salary", "employment_type", "work_mode", "description")],
        F.when(filled(F.col("n.description")).isNotNull(), F.col("n.content_hash")).otherwise(F.coalesce("o.content_hash", "n.content_hash")).alias("content_hash"),
        F.array_union(F.coalesce("o.sources", empty), F.coalesce("n.sources", empty)).alias("sources"),
        F.coalesce("o.first_seen", "n.first_seen", as_of).alias("first_seen"),
        F.when(has_new, as_of).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.col("o.url").isNull().alias("is_new"),
    )


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``, as an aggregate: combined before the shuffle, no sort of groups."""
    others = [c for c in rows.columns if c not in keys]
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return packed.select(*keys, "r.*").select(*rows.columns)


def fresh(postings: DataFrame, as_of: Column, days: float) -> DataFrame:
    """Postings of at most ``days`` before ``as_of``; unknown dates stay. A plain predicate, so it reaches the scan."""
    return postings.filter(F.col("posted_date").isNull() | (F.col("posted_date") >= as_of - F.expr(f"INTERVAL '{days}' DAY")))
