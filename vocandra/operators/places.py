"""Typed locations to places: remote work, a known place, its country, its region, its code, else the cleaned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocandra.operators.skills import spellings_in
from vocandra.session import broadcast_if_small, stage

REMOTE = r"\bremote\b|work from home|\bwfh\b|anywhere|virtual"


def place_text(c: Column) -> Column:
    """Lower-cased words parted by single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def spellings(places: DataFrame) -> DataFrame:
    """(alias, place, step, place_id): what stands for a place, in the order of trial."""
    none = F.array().cast("array<string>")
    named = places.select(F.explode(F.concat(F.array("name"), F.coalesce("alt_names", none))).alias("text"), F.col("name").alias("place"), F.lit(0).alias("step"), "place_id")
    wider = [places.select(F.col(c).alias("text"), F.lower(c if step < 3 else "region").alias("place"), F.lit(step).alias("step"), "place_id") for step, c in ((1, "country"), (2, "region"), (3, "site_code"))]
    for frame in wider:
        named = named.union(frame)
    return named.select(place_text(F.col("text")).alias("alias"), "place", "step", "place_id").filter("alias <> ''")


def located(values: DataFrame, places: DataFrame) -> DataFrame:
    """values: (value), distinct, null for none. (value, place)."""
    known = stage(spellings(places), "places")
    texts = values.filter("value IS NOT NULL").select(F.col("value").alias("key"), F.col("value").alias("text"))
    hits = spellings_in(texts, known, clean_text=place_text, least=2).join(broadcast_if_small(known), "alias")
    best = hits.groupBy(F.col("key").alias("value")).agg(F.min_by("place", F.struct("step", "place_id", "place")).alias("known"))
    met = values.join(best, F.col("known").isNotNull() & values["value"].eqNullSafe(best["value"]), "left").select(values["value"], "known")
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("value", F.lit(""))), r"\s+", " "))
    return met.select("value", F.when(F.lower("value").rlike(REMOTE), "remote").otherwise(F.coalesce("known", plain)).alias("place"))
