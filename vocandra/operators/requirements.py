"""Requirements of postings: extraction by rules, merging with a model's extraction, fingerprints, raw levels, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocandra.functions import detect, experience, text
from vocandra.operators import skills

REQUIRED, PREFERRED = 15, 10
CONFIDENCE, BARE_CONFIDENCE, MERGED_SHARE = 0.7, 0.5, 0.9
START, DOMAIN_START, LONGEST_SENTENCE, RESPONSIBILITIES = 400, 800, 300, 6
#: Fields in the order of the fingerprint; responsibilities don't count.
FINGERPRINT = (
    "min_experience_years", "max_experience_years", "experience_text", "experience_domain", "experience_confidence",
    "required_skills", "preferred_skills", "seniority", "employment_type", "work_mode", "extraction_method",
)
# The levels that scrapers deliver.
RAW_LEVELS = {
    "internship": "intern", "entry": "entry", "associate": "junior", "mid-senior level": "senior", "mid senior level": "senior",
    "director": "manager", "executive": "manager",
}


def raw_level(c: Column) -> Column:
    """The seniority of a scraper's level; mid for what isn't known."""
    key, out = F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("mid")
    for raw, level in RAW_LEVELS.items():
        out = F.when(key == raw, level).otherwise(out)
    return out


def extracted(jobs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Requirements by rules alone, one row per posting (job_id, title, location, description, employment_type, work_mode, job_level_raw).

    The fields of a posting are one narrow projection; only the skills' scan shuffles, by posting.
    """
    x = F.col("x")
    start = F.substr("description", F.lit(1), F.lit(START))
    level = detect.seniority(F.col("title"))
    stated = F.length(F.trim(F.coalesce("job_level_raw", F.lit("")))) > 0
    domain = experience.domain_of(x["sentence"], F.col("title"), F.substr("description", F.lit(1), F.lit(DOMAIN_START)))
    rows = jobs.withColumn("x", experience.experience(F.col("description"))).select(
        "job_id",
        x["min_years"].alias("min_experience_years"),
        x["max_years"].alias("max_experience_years"),
        F.coalesce(F.substr(x["sentence"], F.lit(1), F.lit(LONGEST_SENTENCE)), F.lit("")).alias("experience_text"),
        F.when(x.isNotNull(), domain).otherwise("general").alias("experience_domain"),
        F.when(x.isNull(), 0.0).when(x["kind"] == "bare", BARE_CONFIDENCE).otherwise(CONFIDENCE).alias("experience_confidence"),
        F.when((level == "mid") & stated, raw_level(F.col("job_level_raw"))).otherwise(level).alias("seniority"),
        detect.employment_type(F.col("employment_type"), F.col("title"), start).alias("employment_type"),
        detect.work_mode(F.col("work_mode"), F.col("title"), F.col("location"), start).alias("work_mode"),
        F.when(x.isNotNull(), "regex").otherwise("none").alias("extraction_method"),
    )
    named = skills.scan(jobs.select(F.col("job_id").alias("key"), F.col("description").alias("text")), taxonomy, REQUIRED + PREFERRED)
    # At most 25 skills a posting.
    lists = named.groupBy(F.col("key").alias("job_id")).agg(F.array_sort(F.collect_list(F.struct("place", "skill"))).alias("s"))
    lists = lists.select("job_id", F.transform("s", lambda p: p["skill"]).alias("s"))
    none = F.array().cast("array<string>")
    both = rows.join(lists, "job_id", "left").withColumn("s", F.coalesce("s", none))
    required, preferred = F.slice("s", 1, REQUIRED), F.slice("s", REQUIRED + 1, PREFERRED)
    return both.withColumns({"required_skills": required, "preferred_skills": preferred, "responsibilities": none}).drop("s")


def merged(by_rules: DataFrame, by_model: DataFrame) -> DataFrame:
    """Requirements by rules merged with a model's, by job_id; both have the columns of ``extracted``.

    The model's bounds count where it gave a least number of years, its domain unless it is general, its skills always; the
    title's level counts where it is known. Without a model's row the rules' row stays.
    """
    r, m = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"m.{c}"))
    met = by_rules.alias("r").join(by_model.alias("m"), "job_id", "left")
    has, filled = m("extraction_method").isNotNull(), m("min_experience_years").isNotNull()
    from_rules = ~filled & r("min_experience_years").isNotNull()
    pick = lambda c, rules: F.when(~has | rules, r(c)).otherwise(m(c)).alias(c)
    confidence = F.when(~has | from_rules, r("experience_confidence")).when(
        filled, F.greatest(m("experience_confidence"), r("experience_confidence") * MERGED_SHARE)
    ).otherwise(m("experience_confidence"))
    return met.select(
        "job_id",
        *[pick(c, from_rules) for c in ("min_experience_years", "max_experience_years", "experience_text")],
        pick("experience_domain", (m("experience_domain") == "general") & (r("experience_domain") != "general")),
        confidence.alias("experience_confidence"),
        *[pick(c, F.lit(False)) for c in ("required_skills", "preferred_skills")],
        pick("seniority", r("seniority") != "unknown"),
        *[pick(c, F.lit(False)) for c in ("employment_type", "work_mode", "responsibilities")],
        F.when(has, "merged").otherwise(r("extraction_method")).alias("extraction_method"),
    )


def fingerprint(rows: DataFrame) -> Column:
    """A hash that changes with any field but the responsibilities; null and empty differ."""
    kinds = dict(rows.dtypes)
    parts = [F.array_join(c, "\x1f") if kinds[c].startswith("array") else F.col(c).cast("string") for c in FINGERPRINT]
    return F.sha2(F.concat_ws("\x1e", *[F.coalesce(p, F.lit("\x00")) for p in parts]), 256)


def years_asked(low: Column, high: Column) -> Column:
    a, b = text.plain_number(low), text.plain_number(high)
    both = F.concat(a, F.lit("-"), b, F.lit(" years"))
    return F.coalesce(both, F.concat(a, F.lit("+ years")), F.concat(F.lit("up to "), b, F.lit(" years")), F.lit("not specified"))


def posting_text(size: int) -> Column:
    """The text that is embedded for a posting, of columns of postings joined with their requirements; lists may be null."""
    none = F.array().cast("array<string>")
    lists = [F.coalesce(c, none) for c in ("required_skills", "preferred_skills")]
    known = lambda c: F.coalesce(F.col(c), F.lit(""))
    domain = F.replace(F.coalesce("experience_domain", F.lit("general")), F.lit("_"), F.lit(" "))
    line = lambda name, *parts: F.concat(F.lit(f"{name}: "), *parts)
    return F.concat_ws(
        "\n",
        line("TITLE", known("title")),
        line("COMPANY", known("company")),
        line("LOCATION", known("location"), F.lit(" | WORK MODE: "), known("work_mode")),
        line("SKILLS", F.array_join(F.concat(*lists), ", ")),
        line("EXPERIENCE", years_asked(F.col("min_experience_years"), F.col("max_experience_years")), F.lit(" in "), domain),
        line("RESPONSIBILITIES", F.array_join(F.slice(F.coalesce("responsibilities", none), 1, RESPONSIBILITIES), "; ")),
        line("DOMAIN", domain),
        line("DESCRIPTION", text.excerpt(known("description"), size)),
    )
