"""Résumé texts to profiles without a model: name, title, years, skills, roles, places, summary; completion of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocandra.functions import detect, experience
from vocandra.functions.text import sentences
from vocandra.operators import skills
from vocandra.operators.profiles import resume_name
from vocandra.session import broadcast_if_small, stage

MOST_SKILLS, CORE, SECONDARY, DEFAULT_CORE, ROLES, MOST_YEARS = 50, 12, 18, 10, 6, 45
# Words of titles, of domains of years, roles by the category of skills, headings.
TITLE_WORDS = r"(?i)engineer|developer|scientist|analyst|manager|architect|consultant"
ROLE_WORDS = r"(?i)engineer|developer|scientist|analyst|architect"
DOMAIN_WORDS = {
    "machine learning": "machine_learning", "deep learning": "deep_learning", "computer vision": "computer_vision", "cv": "computer_vision", "nlp": "nlp",
    "deployment": "model_deployment", r"quantiz\w*": "quantization", "mlops": "mlops", "software": "software_engineering", r"network\w*": "networking", "telecom": "networking",
}
RELEVANT = ("machine_learning", "deep_learning", "computer_vision", "nlp", "genai", "model_deployment", "quantization", "mlops")
CATEGORY_ROLES = {
    "MODEL_DEPLOYMENT": "ML Deployment Engineer", "COMPUTER_VISION": "Computer Vision Engineer", "DEEP_LEARNING": "Deep Learning Engineer", "NLP": "NLP Engineer",
    "GENAI": "AI Engineer", "MLOPS": "MLOps Engineer", "CLASSICAL_ML": "Machine Learning Engineer",
}
DEFAULT_ROLES = ("Machine Learning Engineer", "AI Engineer", "Deep Learning Engineer")
SUMMARY_HEAD = r"(?i)(?:professional\s+)?summary|about\s+me|profile|objective"
OTHER_HEAD = r"^(?i:(?:technical\s+)?skills?(?:\s*&\s*tools)?\s*:?\s*)$|^[A-Z][A-Z /&+,\-]{3,40}$"
END_OF_ROLES = r"(?i)experience|education|skills|summary"
_NONE = "array<string>"


def fingerprint(c: Column, model: Column, version: str = "1") -> Column:
    """Of a résumé read by a model: changes with the text, the model and the version of the reader."""
    return F.sha2(F.concat_ws("|", F.lit(version), model, F.sha2(F.coalesce(c, F.lit("")), 256)), 256)


def lines_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def title_line(c: Column) -> Column:
    """The first of six lines, the name left out, that names an occupation."""
    fits = F.filter(F.slice(lines_of(c), 1, 6), lambda s: s.rlike(TITLE_WORDS) & (F.length(s) < 90) & ~s.eqNullSafe(resume_name(c)))
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(""))


def total_years(c: Column) -> Column:
    """The most years that a sentence about experience claims; ranges by their lower end, 0 for none."""
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")
    about = F.filter(F.when(flat.rlike(experience.NUMBER_OF_YEARS), sentences(flat)), lambda s: s.rlike(experience.CONTEXT) & s.rlike(experience.NUMBER_OF_YEARS))
    numbers_by = lambda pattern: F.flatten(F.transform(about, lambda s: F.regexp_extract_all(s, F.lit(pattern), F.lit(1))))
    claimed = [numbers_by(pattern) for _, pattern, _ in experience.YEARS]
    numbers = F.transform(F.concat(*claimed), lambda n: n.try_cast("double"))
    return F.coalesce(F.array_max(F.filter(numbers, lambda n: (n > 0) & (n <= MOST_YEARS))), F.lit(0.0))


def domain_years(c: Column) -> Column:
    """Map of domains to the most years claimed near their names."""
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")
    pattern = rf"(?i)(\d{{1,2}}(?:\.\d)?)\s*\+?\s*(?:years?|yrs?)[^.\n]{{0,30}}?\b({'|'.join(DOMAIN_WORDS)})\b"
    years, words = (F.regexp_extract_all(flat, F.lit(pattern), F.lit(i)) for i in (1, 2))
    key = lambda w: detect.first_match(F.lower(w), [(f"^(?:{p})$", d) for p, d in DOMAIN_WORDS.items()], F.lit("networking"))
    met = F.zip_with(years, words, lambda n, w: F.struct(key(w).alias("domain"), n.try_cast("double").alias("years")))
    most = lambda d: F.array_max(F.transform(F.filter(met, lambda x: x["domain"] == d), lambda x: x["years"]))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(met, lambda x: x["domain"])), lambda d: F.struct(d, most(d))))


def relevant_years(domains: Column) -> Column:
    return F.coalesce(F.greatest(*[F.try_element_at(domains, F.lit(d)) for d in RELEVANT]), F.lit(0.0))


def reconciled(total: Column, relevant: Column) -> tuple[Column, Column]:
    """(total, relevant): each stands in for the other where it is missing; relevant is total at most."""
    total, relevant = F.coalesce(total, F.lit(0.0)), F.coalesce(relevant, F.lit(0.0))
    whole = F.when(total > 0, total).otherwise(relevant)
    return whole, F.when((relevant > 0) & (relevant <= whole), relevant).otherwise(whole)


def role_items(c: Column, heading: str) -> Column:
    """Roles listed below a heading, up to eight lines or the next known section, parted by commas."""
    part = F.split(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?i){heading}\s+roles?\s*:?\s*\n((?:.*\n?){{0,8}})", 1), "\n")
    lines = F.transform(part, lambda s: F.regexp_replace(s, r"^[\s\-•*]+|[\s\-•*]+$", ""))
    stop = F.array_position(F.transform(lines, lambda s: (s == "") | s.rlike(END_OF_ROLES)), True)
    kept = F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)
    items = F.flatten(F.transform(kept, lambda s: F.transform(F.split(s, ","), lambda x: F.trim(x))))
    return F.filter(items, lambda s: (F.length(s) > 3) & (F.length(s) < 60))


def summary_of(c: Column) -> Column:
    """Up to five lines below a summary's heading, where they are a paragraph; else a long second line."""
    lines = lines_of(c)
    head = F.array_position(F.transform(F.slice(lines, 1, 20), lambda s: s.rlike(SUMMARY_HEAD)), True).cast("int")
    below = F.slice(lines, head + 1, F.lit(5))
    stop = F.array_position(F.transform(below, lambda s: s.rlike(OTHER_HEAD)), True).cast("int")
    block = F.array_join(F.when(stop > 0, F.slice(below, F.lit(1), stop - 1)).otherwise(below), " ")
    second = F.try_element_at(lines, F.lit(2))
    return F.when((head > 0) & F.length(block).between(21, 599), block).when(F.length(second) > 40, second).otherwise("")


def normalised_lists(lists: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """lists: (key, list, names). The names resolved, each skill once where it is first named: (key, list, skills, categories)."""
    items = lists.select("key", "list", F.posexplode("names").alias("at", "name")).filter(F.length(F.trim("name")) > 0)
    known = broadcast_if_small(stage(skills.resolve(items.select("name").distinct(), taxonomy), "resolved"))
    first = items.join(known, "name").groupBy("key", "list", F.lower("skill").alias("low"))
    first = first.agg(F.min_by(F.struct("skill", "category"), "at").alias("s"), F.min("at").alias("at"))
    # A list is one person's or posting's own.
    packed = first.groupBy("key", "list").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("l"))
    return packed.select("key", "list", F.transform("l", lambda x: x["s"]["skill"]).alias("skills"), F.transform("l", lambda x: x["s"]["category"]).alias("categories"))


def inferred_roles(title: Column, categories: Column) -> Column:
    """The title, then a role per category of skills, then the defaults; ``ROLES`` at most."""
    own = F.when(F.trim(title) != "", F.array(F.trim(title))).otherwise(F.array().cast(_NONE))
    by_skill = [F.when(F.array_contains(categories, c), F.lit(r)) for c, r in CATEGORY_ROLES.items()]
    roles = F.array_distinct(F.concat(own, F.array_compact(F.array(*by_skill))))
    return F.slice(F.when(F.size(roles) > 0, roles).otherwise(F.array(*map(F.lit, DEFAULT_ROLES))), 1, ROLES)


def completed(profiles: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Profiles with their skills normalised and gaps filled: core skills, target roles, years, seniority.

    Core skills belong to the skills; without core skills the first ``DEFAULT_CORE`` are core.
    """
    names = ("skills", "core_skills", "secondary_skills")
    lists = profiles.select(F.col("id").alias("key"), F.explode(F.array(*[F.struct(F.lit(n).alias("list"), F.col(n).alias("names")) for n in names])).alias("l")).select("key", "l.*")
    done = normalised_lists(lists, taxonomy)
    wide = done.groupBy(F.col("key").alias("id")).agg(
        *[F.max_by("skills", F.when(F.col("list") == n, 1)).alias(f"_{n}") for n in names],
        F.array_distinct(F.flatten(F.collect_list("categories"))).alias("_categories"),
    )
    none = F.array().cast(_NONE)
    rows = profiles.join(wide, "id", "left").withColumns({f"_{n}": F.coalesce(f"_{n}", none) for n in names} | {"_categories": F.coalesce("_categories", none)})
    known = F.transform("_skills", lambda s: F.lower(s))
    every = F.concat("_skills", F.filter("_core_skills", lambda s: ~F.array_contains(known, F.lower(s))))
    rows = rows.withColumn("_skills", F.when(F.size(every) > 0, every).otherwise(F.col("_secondary_skills")))
    rows = rows.withColumn("_core_skills", F.when(F.size("_core_skills") > 0, F.col("_core_skills")).otherwise(F.slice("_skills", 1, DEFAULT_CORE)))
    filled = lambda c: F.filter(F.transform(c, lambda s: F.trim(s)), lambda s: s != "")
    roles = filled("target_roles")
    total, relevant = reconciled(F.col("total_experience_years"), F.col("relevant_experience_years"))
    rows = rows.withColumns({n: F.col(f"_{n}") for n in names} | {
        "target_roles": F.when(F.size(roles) > 0, roles).otherwise(inferred_roles(F.col("current_title"), F.col("_categories"))),
        "excluded_roles": filled("excluded_roles"), "total_experience_years": total, "relevant_experience_years": relevant,
    })
    level = detect.seniority(F.col("current_title"))
    by_years = detect.seniority_from_years(F.col("total_experience_years"), F.col("relevant_experience_years"))
    return rows.withColumn("inferred_seniority", F.when(level.isin("mid", "unknown"), by_years).otherwise(level)).select(*profiles.columns)


def read_resumes(texts: DataFrame, taxonomy: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """texts: (id, text). One profile per résumé, by rules alone. places: (id, place) found elsewhere, if any."""
    named = skills.scan(texts.select(F.col("id").alias("key"), "text"), taxonomy, MOST_SKILLS)
    lists = named.groupBy(F.col("key").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", "skill", "category"))).alias("s"))
    rows = texts.join(lists, "id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<place:int,skill:string,category:string>>")))
    c = F.col("text")
    rows = rows.withColumns({"skills": F.transform("s", lambda x: x["skill"]), "by_domain": domain_years(c), "title": title_line(c), "wanted": F.filter(role_items(c, "target"), lambda s: s.rlike(ROLE_WORDS))})
    total, relevant = reconciled(total_years(c), relevant_years(F.col("by_domain")))
    remote = F.when(c.rlike(r"(?i)\bremote\b|work from home"), F.array(F.lit("Remote"))).otherwise(F.array().cast(_NONE))
    if places is not None:
        listed = places.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("place")), 1, 3).alias("at"))
        rows = rows.join(listed, "id", "left")
        remote = F.concat(F.coalesce("at", F.array().cast(_NONE)), remote)
    return rows.select(
        "id", F.coalesce(resume_name(c), F.lit("")).alias("name"), F.col("title").alias("current_title"), total.alias("total_experience_years"), relevant.alias("relevant_experience_years"),
        F.col("by_domain").alias("experience_by_domain"), "skills", F.slice("skills", 1, CORE).alias("core_skills"), F.slice("skills", CORE + 1, SECONDARY).alias("secondary_skills"),
        F.when(F.size("wanted") > 0, F.col("wanted")).otherwise(inferred_roles(F.col("title"), F.transform("s", lambda x: x["category"]))).alias("target_roles"),
        role_items(c, r"exclud\w+").alias("excluded_roles"), remote.alias("locations"), summary_of(c).alias("summary"),
    )
