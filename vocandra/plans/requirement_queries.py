"""Queries of requirements, embedded texts, completed profiles and reports, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocandra.operators import profiles, requirements, resumes, skills
from vocandra.plans import core_queries as core
from vocandra.plans.core_queries import ORACLES as _CORE
from vocandra.plans.core_queries import query
from vocandra.session import stage, table
from vocandra.sources import sinks

_RAW = (
    "CASE lower(trim(coalesce(job_level_raw, ''))) WHEN 'internship' THEN 'intern' WHEN 'entry' THEN 'entry' WHEN 'associate' THEN 'junior' WHEN 'mid-senior level' THEN 'senior' "
    "WHEN 'mid senior level' THEN 'senior' WHEN 'director' THEN 'manager' WHEN 'executive' THEN 'manager' ELSE 'mid' END"
)


@query(f"SELECT job_level_raw, {_RAW} AS level, count(*) AS jobs FROM jobs GROUP BY job_level_raw")
def raw_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "jobs").groupBy("job_level_raw").agg(F.count("*").alias("jobs"))
    return rows.select("job_level_raw", requirements.raw_level(F.col("job_level_raw")).alias("level"), "jobs")


_EXTRACTED = f"""x AS (SELECT * FROM ({core._years_sql(", s AS sentence")})), k AS (SELECT * FROM ({_CORE["skill_scan"]})),
    lists AS (SELECT job_id, string_agg(skill, '; ' ORDER BY place) FILTER (place <= 15) AS required, string_agg(skill, '; ' ORDER BY place) FILTER (place > 15) AS preferred FROM k WHERE place <= 25 GROUP BY job_id),
    t AS (SELECT *, lower(concat_ws(' ', work_mode, title, location, left(description, 400))) AS c, lower(concat_ws(' ', employment_type, title, left(description, 400))) AS e, lower(regexp_replace(trim(title), '\\s+', ' ', 'g')) AS s FROM jobs),
    y AS (SELECT job_id, {core._MODES} AS work_mode, {core._EMPLOYMENTS} AS employment_type, CASE WHEN trim(title) = '' THEN 'unknown' ELSE {core._SENIORITIES} END AS by_title, trim(coalesce(job_level_raw, '')) <> '' AS stated, {_RAW} AS raw FROM t),
    extracted AS (SELECT y.job_id, x.min_years AS min_experience_years, x.max_years AS max_experience_years, coalesce(left(x.sentence, 300), '') AS experience_text, coalesce(x.experience_domain, 'general') AS experience_domain,
        CASE WHEN x.kind IS NULL THEN 0.0 WHEN x.kind = 'bare' THEN 0.5 ELSE 0.7 END AS experience_confidence, CASE WHEN by_title = 'mid' AND stated THEN raw ELSE by_title END AS seniority, employment_type, work_mode,
        CASE WHEN x.kind IS NULL THEN 'none' ELSE 'regex' END AS extraction_method, coalesce(required, '') AS required, coalesce(preferred, '') AS preferred
        FROM y LEFT JOIN x USING (job_id) LEFT JOIN lists USING (job_id))"""
_LISTS = {"required": "required_skills", "preferred": "preferred_skills"}


def _joined(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c not in (*_LISTS.values(), "responsibilities")]
    return rows.select(*others, *[F.array_join(c, "; ").alias(name) for name, c in _LISTS.items()])


@query(f"WITH {_EXTRACTED} SELECT * FROM extracted")
def extracted_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(requirements.extracted(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "skills")))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "job_requirements")
    none = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(F.from_json(f"{c}_json", "array<string>"), none) for c in ("required_skills", "preferred_skills", "responsibilities")})


_JSON_LIST = "coalesce(from_json({0}_json, '[\"VARCHAR\"]'), [])"
_STORED_LISTS = ", ".join(f"array_to_string({_JSON_LIST.format(c)}, '; ') AS {n}" for n, c in _LISTS.items())


@query(
    f"""WITH {_EXTRACTED}, m AS (SELECT * EXCLUDE (required_skills_json, preferred_skills_json), {_STORED_LISTS} FROM job_requirements)
    SELECT r.job_id, CASE WHEN m.job_id IS NULL OR f THEN r.min_experience_years ELSE m.min_experience_years END AS min_experience_years, CASE WHEN m.job_id IS NULL OR f THEN r.max_experience_years ELSE m.max_experience_years END AS max_experience_years,
        CASE WHEN m.job_id IS NULL OR f THEN r.experience_text ELSE m.experience_text END AS experience_text,
        CASE WHEN m.job_id IS NULL OR (m.experience_domain = 'general' AND r.experience_domain <> 'general') THEN r.experience_domain ELSE m.experience_domain END AS experience_domain,
        CASE WHEN m.job_id IS NULL OR f THEN r.experience_confidence WHEN m.min_experience_years IS NOT NULL THEN greatest(m.experience_confidence, CAST(r.experience_confidence AS DOUBLE) * CAST(0.9 AS DOUBLE)) ELSE m.experience_confidence END AS experience_confidence,
        CASE WHEN m.job_id IS NULL OR r.seniority <> 'unknown' THEN r.seniority ELSE m.seniority END AS seniority, CASE WHEN m.job_id IS NULL THEN r.employment_type ELSE m.employment_type END AS employment_type,
        CASE WHEN m.job_id IS NULL THEN r.work_mode ELSE m.work_mode END AS work_mode, CASE WHEN m.job_id IS NULL THEN r.extraction_method ELSE 'merged' END AS extraction_method,
        CASE WHEN m.job_id IS NULL THEN r.required ELSE m.required END AS required, CASE WHEN m.job_id IS NULL THEN r.preferred ELSE m.preferred END AS preferred
    FROM (SELECT e.*, coalesce(n.min_experience_years IS NULL AND e.min_experience_years IS NOT NULL, false) AS f FROM extracted e LEFT JOIN m n USING (job_id)) r LEFT JOIN m ON m.job_id = r.job_id"""
)
def merged_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules' requirements merged with the stored ones."""
    by_rules = requirements.extracted(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "skills"))
    return _joined(requirements.merged(by_rules, _stored(spark, sf_dir)))


_PARTS = ", ".join(
    f"coalesce(array_to_string({_JSON_LIST.format(c)}, chr(31)), chr(0))" if c in _LISTS.values() else f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in requirements.FINGERPRINT
)


@query()
def requirement_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested by its changes: numbers are spelt differently by engines."""
    rows = _stored(spark, sf_dir)
    return rows.select("job_id", requirements.fingerprint(rows).alias("fingerprint"))


_YEARS_TEXT = "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')"
_LOW, _HIGH = _YEARS_TEXT.format("min_experience_years"), _YEARS_TEXT.format("max_experience_years")


@query(
    f"""WITH r AS (SELECT job_id, min_experience_years, max_experience_years, experience_domain, {_JSON_LIST.format("required_skills")} AS a, {_JSON_LIST.format("preferred_skills")} AS b, {_JSON_LIST.format("responsibilities")} AS w FROM job_requirements),
    j AS (SELECT j.job_id, coalesce(title, '') AS title, coalesce(company, '') AS company, coalesce(location, '') AS location, coalesce(work_mode, '') AS work_mode, coalesce(description, '') AS d, replace(coalesce(experience_domain, 'general'), '_', ' ') AS domain,
        array_to_string(list_concat(coalesce(a, []), coalesce(b, [])), ', ') AS skills, array_to_string(coalesce(w, [])[1:6], '; ') AS work, coalesce({_LOW} || '-' || {_HIGH} || ' years', {_LOW} || '+ years', 'up to ' || {_HIGH} || ' years', 'not specified') AS years
        FROM jobs j LEFT JOIN r USING (job_id))
    SELECT job_id, concat_ws(chr(10), 'TITLE: ' || title, 'COMPANY: ' || company, 'LOCATION: ' || location || ' | WORK MODE: ' || work_mode, 'SKILLS: ' || skills, 'EXPERIENCE: ' || years || ' in ' || domain, 'RESPONSIBILITIES: ' || work, 'DOMAIN: ' || domain,
        'DESCRIPTION: ' || {core.sql_excerpt("d", 1500)}) AS text FROM j"""
)
def posting_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _stored(spark, sf_dir).select("job_id", "min_experience_years", "max_experience_years", "experience_domain", "required_skills", "preferred_skills", "responsibilities")
    jobs = table(spark, sf_dir, "jobs").select("job_id", "title", "company", "location", "work_mode", "description")
    return jobs.join(wanted, "job_id", "left").select("job_id", requirements.posting_text(1500).alias("text"))


@query(
    rf"""WITH {core._ALIASES}, {core._ITEMS.replace("AS name FROM job_requirements", "AS name, unnest(range(1, len(from_json(required_skills_json, '[\"VARCHAR\"]')) + 1)) AS n FROM job_requirements", 1).split("UNION ALL")[0]}), items AS (SELECT * FROM raw_items WHERE trim(name) <> ''), {core._RESOLVED.strip()},
    once AS (SELECT job_id, lower(skill) AS low, arg_min(skill, n) AS skill, min(n) AS n FROM items JOIN resolved USING (name) GROUP BY job_id, lower(skill))
    SELECT job_id, string_agg(skill, '; ' ORDER BY n) AS skills FROM once GROUP BY job_id"""
)
def normalised_skill_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _stored(spark, sf_dir).select(F.col("job_id").alias("key"), F.lit("required").alias("list"), F.col("required_skills").alias("names"))
    done = resumes.normalised_lists(lists, table(spark, sf_dir, "skills"))
    return done.select(F.col("key").alias("job_id"), F.array_join("skills", "; ").alias("skills"))


_NUMBER = "CASE WHEN TRY_CAST(json_extract_string(profile_json, '$.{0}') AS DOUBLE) BETWEEN 0 AND 45 THEN TRY_CAST(json_extract_string(profile_json, '$.{0}') AS DOUBLE) ELSE 0 END"


@query(
    f"""WITH p AS (SELECT id, coalesce({_NUMBER.format("total_experience_years")}, 0) AS t, coalesce({_NUMBER.format("relevant_experience_years")}, 0) AS r FROM candidate_profile),
    w AS (SELECT id, CASE WHEN t > 0 THEN t ELSE r END AS t, r FROM p)
    SELECT id, t AS total_experience_years, CASE WHEN r > 0 AND r <= t THEN r ELSE t END AS relevant_experience_years FROM w"""
)
def completed_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profiles.profiles(table(spark, sf_dir, "candidate_profile"))
    total, relevant = resumes.reconciled(F.col("total_experience_years"), F.col("relevant_experience_years"))
    return p.select("id", total.alias("total_experience_years"), relevant.alias("relevant_experience_years"))


@query()
def completed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resumes.completed(profiles.profiles(table(spark, sf_dir, "candidate_profile")), table(spark, sf_dir, "skills"))


@query()
def resume_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by rules of all documents, as if each were a résumé; tested against literal cases."""
    return resumes.read_resumes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, sf_dir, "skills"))


@query("SELECT name, category, CAST(is_alias AS INTEGER) AS is_alias FROM skills WHERE is_alias = 0 UNION SELECT s.name, c.category, 1 FROM skills s JOIN skills c ON c.id = s.canonical_id WHERE s.is_alias = 1")
def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "skills")
    canonical = listed.filter("is_alias = 0")
    other = listed.filter("is_alias = 1").select(F.col("name").alias("alias"), "canonical_id").join(canonical.select("id", "name"), F.col("canonical_id") == F.col("id")).select("alias", "name")
    return skills.taxonomy_rows(canonical.select("name", "category"), other)


@query("SELECT DISTINCT job_id, created_at, verdict, final_score, coalesce(reasoning, '') AS reasoning FROM job_matches")
def match_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches written as JSON objects and read back."""
    rows = table(spark, sf_dir, "job_matches").select("job_id", "created_at", "verdict", "final_score", "reasoning").distinct()
    back = sinks.from_documents(sinks.as_documents(rows, "job_id"), "job_id", "created_at timestamp_ntz, verdict string, final_score double, reasoning string", {"reasoning": ""})
    return back.select("job_id", "created_at", "verdict", "final_score", "reasoning")


_LATEST = """m AS (SELECT * FROM job_matches QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, config_hash DESC, final_score DESC, verdict DESC) = 1)"""
# The columns of the two reports.
SCORES = {"Embedding Score": "embedding_score", "Skill Match Score": "skill_score", "Experience Match Score": "experience_score", "Domain Match Score": "domain_score", "Responsibility Match Score": "responsibility_score", "Career Alignment Score": "career_alignment_score", "Final Match Score": "final_score"}


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = core.postings.latest(table(spark, sf_dir, "job_matches"), ["job_id"], ["created_at", "config_hash", "final_score", "verdict"]).drop("content_hash", "config_hash", "created_at")
    jobs = table(spark, sf_dir, "jobs").select("job_id", "company", "title", "location", "work_mode", "employment_type", "posted_date", "sources", "url")
    wanted = _stored(spark, sf_dir).select("job_id", "min_experience_years", "max_experience_years", "experience_domain", "required_skills", "preferred_skills")
    return best.join(jobs, "job_id").join(wanted, "job_id", "left")


def _score_text(c: str):
    return F.regexp_replace(F.format_number(F.coalesce(c, F.lit(0.0)), 1), ",", "")


_SQL_SCORES = ", ".join(f"""printf('%.1f', coalesce({c}, 0)) AS "{name}" """ for name, c in SCORES.items())


@query()
def matched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the report of matches that the tables give, all rows."""
    rows = _reported(spark, sf_dir).filter(F.col("verdict").isin(*core.MATCHED))
    plain = core.text.plain_number
    return rows.select(
        F.col("company").alias("Company"), F.col("title").alias("Job Title"), F.array_join("sources", ", ").alias("Platform"), F.col("location").alias("Location"), F.col("work_mode").alias("Work Mode"), F.col("employment_type").alias("Employment Type"),
        F.coalesce(F.date_format("posted_date", "yyyy-MM-dd"), F.lit("")).alias("Posted Date"), F.coalesce(plain(F.col("min_experience_years")), F.lit("")).alias("Job Minimum Experience"), F.coalesce(plain(F.col("max_experience_years")), F.lit("")).alias("Job Maximum Experience"),
        F.col("experience_domain").alias("Experience Domain"), F.col("experience_fit").alias("Experience Fit"),
        F.when(F.col("experience_fit").contains("overqualified"), "Yes").otherwise("No").alias("Overqualification Flag"), F.when(F.col("experience_fit") == "underqualified", "Yes").otherwise("No").alias("Underqualification Flag"),
        F.array_join("required_skills", "; ").alias("Required Skills"), F.array_join("preferred_skills", "; ").alias("Preferred Skills"), *[_score_text(c).alias(name) for name, c in SCORES.items()],
        F.col("verdict").alias("Verdict"), F.regexp_replace(F.coalesce("reasoning", F.lit("")), r"\s*[\r\n]+\s*", " ").alias("Reasoning"), F.col("url").alias("Job Link"),
    )


@query(
    f"""WITH {_LATEST} SELECT j.company AS "Company", j.title AS "Job Title", array_to_string(j.sources, ', ') AS "Platform", j.location AS "Location", coalesce({_LOW} || '-' || {_HIGH} || ' years', {_LOW} || '+ years', 'up to ' || {_HIGH} || ' years', 'not specified') AS "Job Experience",
        m.experience_fit AS "Rejection Reason", coalesce(m.reasoning, '') AS "Rejection Detail", j.url AS "Job Link"
    FROM m JOIN jobs j ON j.job_id = m.job_id LEFT JOIN job_requirements r ON r.job_id = m.job_id WHERE m.verdict NOT IN ('MATCH', 'BORDERLINE')"""
)
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of what didn't match, all rows."""
    rows = _reported(spark, sf_dir).filter(~F.col("verdict").isin(*core.MATCHED))
    return rows.select(
        F.col("company").alias("Company"), F.col("title").alias("Job Title"), F.array_join("sources", ", ").alias("Platform"), F.col("location").alias("Location"),
        requirements.years_asked(F.col("min_experience_years"), F.col("max_experience_years")).alias("Job Experience"), F.col("experience_fit").alias("Rejection Reason"), F.coalesce("reasoning", F.lit("")).alias("Rejection Detail"), F.col("url").alias("Job Link"),
    )
