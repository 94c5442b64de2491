"""Profiles: typed columns out of profile documents, and what a plain résumé says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocandra.functions import coerce, detect
from vocandra.functions.text import plain_number

SCHEMA = (
    "name string, current_title string, total_experience_years string, relevant_experience_years string, experience_by_domain map<string,double>, "
    "skills array<string>, core_skills array<string>, secondary_skills array<string>, domains array<string>, target_roles array<string>, education array<string>, "
    "certifications array<string>, locations array<string>, preferred_work_modes array<string>, excluded_roles array<string>, summary string, inferred_seniority string"
)
QUERIES, DEFAULT_QUERIES = 6, ("Data Analyst", "Software Engineer")


def profiles(rows: DataFrame) -> DataFrame:
    """One typed row per profile document; absent keys are empty, years beyond 45 are null."""
    p = F.from_json("profile_json", SCHEMA)
    rows = rows.select("id", p.alias("p"))
    words = [f.split()[0] for f in SCHEMA.split(", ") if f.endswith("array<string>")]
    level = F.coalesce(F.nullif(F.col("p.inferred_seniority"), F.lit("")), F.lit("unknown"))
    return rows.select(
        "id",
        *[F.coalesce(f"p.{c}", F.lit("")).alias(c) for c in ("name", "current_title", "summary")],
        *[coerce.to_years(F.col(f"p.{c}")).alias(c) for c in ("total_experience_years", "relevant_experience_years")],
        F.map_filter(F.coalesce("p.experience_by_domain", F.create_map().cast("map<string,double>")), lambda k, v: v >= 0).alias("experience_by_domain"),
        *[F.filter(F.coalesce(f"p.{c}", F.array().cast("array<string>")), lambda s: F.length(F.trim(s)) > 0).alias(c) for c in words],
        level.alias("inferred_seniority"),
    )


def candidate_level(p: DataFrame) -> Column:
    """The title's level where it is marked, else the level of the years."""
    years = detect.seniority_from_years(F.coalesce(p["total_experience_years"], F.lit(0.0)), F.coalesce(p["relevant_experience_years"], F.lit(0.0)))
    level = detect.seniority(p["current_title"])
    return F.when(level.isin("mid", "unknown"), years).otherwise(level)


def search_queries(p: DataFrame) -> DataFrame:
    """(id, place, query): target roles, then ``skill Engineer``, up to ``QUERIES``."""
    seeds = F.transform(F.when(F.size("core_skills") > 0, F.col("core_skills")).otherwise(F.col("skills")), lambda s: F.concat(s, F.lit(" Engineer")))
    listed = F.slice(F.array_distinct(F.concat("target_roles", seeds)), 1, QUERIES)
    listed = F.when(F.size(listed) > 0, listed).otherwise(F.array(*map(F.lit, DEFAULT_QUERIES)))
    return p.select("id", F.posexplode(listed).alias("at", "query")).select("id", (F.col("at") + 1).alias("place"), "query")


def profile_text(p: DataFrame) -> Column:
    """The text that is embedded for a profile: title, years by domain, skills, summary."""
    entries = F.array_sort(F.map_entries(F.map_filter("experience_by_domain", lambda k, v: v > 0)))
    domains = F.array_join(F.transform(entries, lambda e: F.concat_ws(" ", e["key"], plain_number(e["value"]))), ", ")
    return F.concat_ws(". ", F.nullif("current_title", F.lit("")), F.nullif(domains, F.lit("")), F.nullif(F.array_join(F.slice("skills", 1, 40), ", "), F.lit("")), F.nullif("summary", F.lit("")))


def resume_years(c: Column) -> Column:
    """The most years any sentence about experience names."""
    wrapped = F.regexp_replace(c, r"\s*\n\s*(?=[a-z])", " ")
    about = F.filter(F.split(wrapped, r"(?<=[.!?])\s+|\n+"), lambda s: s.rlike("(?i)experience|years"))
    numbers = F.flatten(F.transform(about, lambda s: F.regexp_extract_all(s, F.lit(r"(?i)(\d{1,2}(?:\.\d)?)\s*\+?\s*(?:years?|yrs?)"), F.lit(1))))
    return F.array_max(F.filter(F.transform(numbers, lambda n: n.cast("double")), lambda n: n <= 45))


def resume_name(c: Column) -> Column:
    """The first of ten lines that can be a name: up to 60 letters and five words, no digits, no address."""
    lines = F.slice(F.filter(F.transform(F.split(c, "\n"), lambda s: F.trim(s)), lambda s: s != ""), 1, 10)
    fits = F.filter(lines, lambda s: (F.length(s) <= 60) & (F.size(F.split(s, r"\s+")) <= 5) & ~s.rlike(r"[\d@]|https?:|www\."))
    return F.try_element_at(fits, F.lit(1))
