"""Queries of the posting pipeline, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocandra.functions import coerce, detect, experience, text, web
from vocandra.operators import postings, profiles, rank, skills
from vocandra.operators.places import located
from vocandra.session import broadcast_if_small, stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def sql_first_match(column: str, patterns: list[tuple[str, str]], otherwise: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({column}, '{quoted(p)}') THEN '{v}'" for p, v in patterns)
    return f"CASE {whens} ELSE {otherwise} END"


def sql_unescape(column: str) -> str:
    for entity, char in text.ENTITIES:
        column = f"replace({column}, '{quoted(entity)}', '{quoted(char)}')"
    return column


_CLEAN = f"regexp_replace(regexp_replace(replace(regexp_replace({sql_unescape("coalesce(description, '')")}, '<[^>]+>', ' ', 'g'), chr(13), chr(10)), '{text.BULLETS}', chr(10) || '- ', 'g'), '[ \t]+', ' ', 'g')"
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace({_CLEAN}, ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT raw_id, {_CLEAN} AS description FROM raw_posting")
def clean_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_posting").select("raw_id", text.clean_description(F.col("description")).alias("description"))


_PARAMS = ", ".join(f"'{p}'" for p in web.KEPT_PARAMETERS)


@query(
    rf"""WITH p AS (SELECT raw_id, trim(coalesce(job_url, '')) AS u FROM raw_posting),
    q AS (SELECT raw_id, u, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?', ['s', 'h', 'p', 'q']) AS r FROM p)
    SELECT raw_id, CASE WHEN r.h = '' THEN u ELSE lower(r.s) || '://' || regexp_replace(lower(r.h), '^www\.', '') || regexp_replace(r.p, '/+$', '')
        || CASE WHEN k = '' THEN '' ELSE '?' || k END END AS url
    FROM (SELECT *, array_to_string(list_filter(string_split(r.q, '&'), lambda x: lower(string_split(x, '=')[1]) IN ({_PARAMS}) AND regexp_matches(x, '=.')), '&') AS k FROM q)"""
)
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_posting").select("raw_id", web.canonical_url(F.col("job_url")).alias("url"))


@query(
    """SELECT raw_id, coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%Y-%m-%d %H:%M:%S'), try_strptime(d, '%Y-%m-%dT%H:%M:%S'),
        try_strptime(d, '%d/%m/%Y'), try_strptime(d, '%m/%d/%Y')) AS posted_date FROM (SELECT raw_id, left(trim(date_posted), 19) AS d FROM raw_posting)"""
)
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_posting").select("raw_id", web.parse_date(F.col("date_posted")).alias("posted_date"))


@query(
    """WITH a AS (SELECT raw_id, nullif(trim(currency), '') AS c, nullif(trim(pay_interval), '') AS i,
        CASE WHEN isnan(min_amount) THEN NULL ELSE format('{:,}', CAST(round_even(min_amount, 0) AS BIGINT)) END AS lo,
        CASE WHEN isnan(max_amount) THEN NULL ELSE format('{:,}', CAST(round_even(max_amount, 0) AS BIGINT)) END AS hi FROM raw_posting)
    SELECT raw_id, CASE WHEN lo IS NULL AND hi IS NULL THEN '' ELSE concat_ws(' ', c, CASE WHEN lo <> hi THEN lo || '-' || hi ELSE coalesce(lo, hi) END, i) END AS salary FROM a"""
)
def pay_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pay = web.pay_text(*[F.col(c) for c in ("min_amount", "max_amount", "currency", "pay_interval")])
    return table(spark, sf_dir, "raw_posting").select("raw_id", pay.alias("salary"))


@query(
    "SELECT job_id, trim(regexp_replace(regexp_replace(lower(trim(coalesce(company, ''))), '"
    + quoted(text.COMPANY_SUFFIX)
    + "', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS company_key, trim(regexp_replace(lower(title), '[^a-z0-9+ ]+', ' ', 'g')) AS title_key FROM jobs"
)
def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jobs").select("job_id", text.company_key(F.col("company")).alias("company_key"), text.title_key(F.col("title")).alias("title_key"))


@query(
    r"""SELECT h AS content_hash, count(*) AS copies FROM (SELECT sha256(lower(trim(regexp_replace(coalesce(company, '') || '|' || title || '|' || coalesce(description, ''), '[ \t\n\r\f\v]+', ' ', 'g')))) AS h FROM jobs)
    GROUP BY h HAVING count(*) > 1"""
)
def content_hash_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "jobs").select(text.content_hash(F.col("company"), F.col("title"), F.col("description")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("copies")).filter("copies > 1")


_MODES = sql_first_match("c", detect.WORK_MODES, "'unknown'")
_EMPLOYMENTS = sql_first_match("e", detect.EMPLOYMENTS, "'unknown'")
_SENIORITIES = sql_first_match("s", detect.SENIORITIES, "'mid'")


@query(
    f"""SELECT job_id, {_MODES} AS work_mode, {_EMPLOYMENTS} AS employment_type, CASE WHEN trim(title) = '' THEN 'unknown' ELSE {_SENIORITIES} END AS seniority
    FROM (SELECT job_id, title, lower(concat_ws(' ', title, location, left(description, 400))) AS c, lower(concat_ws(' ', title, left(description, 400))) AS e,
        lower(regexp_replace(trim(title), '\\s+', ' ', 'g')) AS s FROM jobs)"""
)
def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.substr("description", F.lit(1), F.lit(400))
    return table(spark, sf_dir, "jobs").select(
        "job_id",
        detect.work_mode(F.col("title"), F.col("location"), start).alias("work_mode"),
        detect.employment_type(F.col("title"), start).alias("employment_type"),
        detect.seniority(F.col("title")).alias("seniority"),
    )


_RANK = "CASE {} " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(detect.RANKS)) + " ELSE -1 END"


@query(
    f"""SELECT seniority, count(*) AS jobs, max({_RANK.format('seniority')}) AS rank, round(avg(min_experience_years), 6) AS mean_min_years FROM job_requirements GROUP BY seniority"""
)
def seniority_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "job_requirements").groupBy("seniority")
    return rows.agg(F.count("*").alias("jobs"), F.max(detect.seniority_rank(F.col("seniority"))).alias("rank"), F.round(F.avg("min_experience_years"), 6).alias("mean_min_years"))


_PLACE_TEXT = r"trim(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(
    rf"""WITH named AS (SELECT unnest(list_concat([name], coalesce(alt_names, []))) AS t, name AS place, 0 AS step, place_id FROM ref_place
        UNION ALL SELECT country, lower(country), 1, place_id FROM ref_place UNION ALL SELECT region, lower(region), 2, place_id FROM ref_place UNION ALL SELECT site_code, lower(region), 3, place_id FROM ref_place),
    alias AS (SELECT {_PLACE_TEXT.format("t")} AS alias, place, step, place_id FROM named),
    v AS (SELECT DISTINCT location AS v FROM jobs),
    hit AS (SELECT v, arg_min(place, step * 1000000 + place_id) AS place FROM v JOIN alias ON length(alias) >= 2 AND contains(' ' || {_PLACE_TEXT.format("v")} || ' ', ' ' || alias || ' ') GROUP BY v),
    known AS (SELECT v.v, CASE WHEN regexp_matches(lower(v.v), '\bremote\b|work from home|\bwfh\b|anywhere|virtual') THEN 'remote'
        ELSE coalesce(hit.place, trim(regexp_replace(lower(coalesce(v.v, '')), '\s+', ' ', 'g'))) END AS place FROM v LEFT JOIN hit ON hit.v = v.v)
    SELECT place, count(*) AS jobs FROM jobs JOIN known ON jobs.location IS NOT DISTINCT FROM known.v GROUP BY place"""
)
def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations by the reference list of places."""
    jobs = table(spark, sf_dir, "jobs").groupBy(F.col("location").alias("value")).agg(F.count("*").alias("n"))
    jobs = stage(jobs, "locations")
    known = located(jobs.select("value"), table(spark, sf_dir, "ref_place"))
    met = jobs.join(known.withColumnRenamed("value", "v"), F.col("value").eqNullSafe(F.col("v")))
    return met.groupBy("place").agg(F.sum("n").alias("jobs"))


@query(
    r"""WITH s AS (SELECT job_id, unnest(string_split(regexp_replace(regexp_replace(description, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+|[•●▪]', chr(1), 'g'), chr(1))) AS s FROM jobs)
    SELECT job_id, count(*) AS sentences, max(length(trim(s, ' '))) AS longest FROM s WHERE trim(s, ' ') <> '' GROUP BY job_id"""
)
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "jobs").select("job_id", F.explode(text.sentences(F.col("description"))).alias("s"))
    return found.groupBy("job_id").agg(F.count("*").alias("sentences"), F.max(F.length("s")).alias("longest"))


def _years_sql(more: str = "") -> str:
    options = []
    for k, (weight, pattern, kind) in enumerate(experience.YEARS):
        p = quoted(pattern.replace("(?iu)", "(?i)"))
        low = f"try_cast(regexp_extract(s, '{p}', 1) AS DOUBLE)"
        high = f"try_cast(regexp_extract(s, '{p}', 2) AS DOUBLE)" if kind == "range" else "CAST(NULL AS DOUBLE)"
        ok = f"lo <= {experience.MOST_YEARS}" + (f" AND hi >= lo AND hi <= {experience.MOST_YEARS}" if kind == "range" else "")
        options.append(f"SELECT * FROM (SELECT job_id, title, description, n, s, {weight} + b AS w, {k} AS k, {low} AS lo, {high} AS hi, '{kind}' AS kind FROM c) WHERE {ok}")
    domain = lambda c: sql_first_match(f"lower({c})", experience.DOMAINS, "NULL")
    return rf"""
    WITH parts AS (SELECT job_id, title, description, string_split(regexp_replace(regexp_replace(description, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+|[•●▪]', chr(1), 'g'), chr(1)) AS p FROM jobs),
    numbered AS (SELECT job_id, title, description, unnest(p) AS s, unnest(range(len(p))) AS n FROM parts),
    c AS (SELECT job_id, title, description, trim(s, ' ') AS s, n, CASE WHEN regexp_matches(s, '(?i)experience|expertise|professional|career|worked') THEN 2.0 ELSE 0.0 END AS b FROM numbered WHERE trim(s, ' ') <> ''),
    m AS ({' UNION ALL '.join(options)}),
    best AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY w DESC, n, k) AS r FROM m)
    SELECT job_id, lo AS min_years, hi AS max_years, kind{more}, coalesce({domain('s')}, {domain('title')}, {domain('left(description, 800)')}, 'general') AS experience_domain
    FROM best WHERE r = 1 AND NOT (kind = 'bare' AND w < 3.0)"""


@query(_years_sql())
def experience_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs").withColumn("x", experience.experience(F.col("description"))).filter("x IS NOT NULL")
    domain = experience.domain_of(F.col("x.sentence"), F.col("title"), F.substr("description", F.lit(1), F.lit(800)))
    return jobs.select("job_id", "x.min_years", "x.max_years", "x.kind", domain.alias("experience_domain"))


_ALIASES = r"""
    named AS (SELECT s.id, trim(regexp_replace(regexp_replace(replace(lower(s.name), '’', ''''), '[^a-z0-9#+/ ]+', ' ', 'g'), '\s+', ' ', 'g')) AS alias, c.name AS skill, c.category FROM skills s JOIN skills c ON c.id = s.canonical_id),
    alias AS (SELECT alias, arg_min(skill, id) AS skill, arg_min(category, id) AS category, min(id) AS id FROM named WHERE alias <> '' GROUP BY alias)"""


@query(
    rf"""WITH {_ALIASES}, t AS (SELECT job_id, ' ' || trim(regexp_replace(regexp_replace(replace(lower(description), '’', ''''), '[^a-z0-9#+/ ]+', ' ', 'g'), '\s+', ' ', 'g')) || ' ' AS t FROM jobs),
    hits AS (SELECT job_id, skill, any_value(category) AS category, min(-length(alias) * 100000 + id) AS rank FROM t JOIN alias ON length(alias) >= 3 AND contains(t, ' ' || alias || ' ') GROUP BY job_id, skill)
    SELECT job_id, skill, category, CAST(row_number() OVER (PARTITION BY job_id ORDER BY rank) AS INTEGER) AS place FROM hits"""
)
def skill_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "jobs").select(F.col("job_id").alias("key"), F.col("description").alias("text"))
    return skills.scan(texts, table(spark, sf_dir, "skills")).withColumnRenamed("key", "job_id")


def _requirement_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "job_requirements")
    parts = [rows.select("job_id", F.lit(c == "required_skills_json").alias("required"), F.posexplode(F.from_json(c, "array<string>")).alias("at", "name")) for c in ("required_skills_json", "preferred_skills_json")]
    return parts[0].union(parts[1]).filter(F.length(F.trim("name")) > 0)


_ITEMS = """
    raw_items AS (SELECT job_id, true AS required, unnest(from_json(required_skills_json, '["VARCHAR"]')) AS name FROM job_requirements
        UNION ALL SELECT job_id, false, unnest(from_json(preferred_skills_json, '["VARCHAR"]')) FROM job_requirements),
    items AS (SELECT * FROM raw_items WHERE trim(name) <> '')"""
_RESOLVED = rf"""
    names AS (SELECT DISTINCT name, trim(regexp_replace(regexp_replace(replace(lower(name), '’', ''''), '[^a-z0-9#+/ ]+', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM items),
    inside AS (SELECT name, arg_min(skill, -length(alias) * 100000 + alias.id) AS skill, arg_min(category, -length(alias) * 100000 + alias.id) AS category FROM names JOIN alias ON length(alias) >= 3 AND contains(' ' || norm || ' ', ' ' || alias || ' ') GROUP BY name),
    resolved AS (SELECT n.name, coalesce(a.skill, i.skill, left(trim(regexp_replace(n.name, '\s+', ' ', 'g')), 80)) AS skill, coalesce(a.category, i.category) AS category FROM names n LEFT JOIN alias a ON a.alias = n.norm LEFT JOIN inside i ON i.name = n.name)"""


@query(f"WITH {_ALIASES}, {_ITEMS}, {_RESOLVED} SELECT name, skill, category FROM resolved")
def skill_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.resolve(_requirement_items(spark, sf_dir).select("name").distinct(), table(spark, sf_dir, "skills"))


# Neighbouring categories of the skills table, both ways.
NEIGHBOURS = [("LEARNING", "VISION"), ("LEARNING", "LANGUAGE"), ("LEARNING", "DEPLOY"), ("LEARNING", "DATA"), ("DEPLOY", "CLOUD"), ("DEPLOY", "SOFTWARE"), ("CLOUD", "SOFTWARE"), ("DATA", "SOFTWARE"), ("CODING", "SOFTWARE")]
_PAIRS = ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in NEIGHBOURS)


@query(
    f"""WITH {_ALIASES}, {_ITEMS}, {_RESOLVED}, pairs(a, b) AS (VALUES {_PAIRS}),
    wanted AS (SELECT job_id, skill, any_value(category) AS category, bool_or(required) AS required FROM items JOIN resolved USING (name) GROUP BY job_id, skill),
    offered AS (SELECT DISTINCT p.id AS candidate, s.name AS skill, s.category FROM (SELECT id, unnest(from_json(json_extract(profile_json, '$.skills'), '["VARCHAR"]')) AS name FROM candidate_profile) p
        JOIN (SELECT * FROM skills WHERE is_alias = 0) s ON s.name = p.name),
    roles AS (SELECT DISTINCT id AS candidate, unnest(from_json(json_extract(profile_json, '$.target_roles'), '["VARCHAR"]')) AS title FROM candidate_profile),
    sought AS (SELECT DISTINCT r.candidate, j.job_id FROM roles r JOIN jobs j USING (title)),
    kinds AS (SELECT e.candidate, w.*, CASE
        WHEN EXISTS (SELECT 1 FROM offered o WHERE o.candidate = e.candidate AND lower(o.skill) = lower(w.skill)) THEN 1.0
        WHEN EXISTS (SELECT 1 FROM offered o WHERE o.candidate = e.candidate AND o.category = w.category) THEN 0.75
        WHEN EXISTS (SELECT 1 FROM offered o JOIN pairs ON pairs.b = o.category WHERE o.candidate = e.candidate AND pairs.a = w.category) THEN 0.5 ELSE 0.0 END AS worth
        FROM wanted w JOIN sought e USING (job_id))
    SELECT candidate AS candidate_id, job_id, count(*) AS skills, count(*) FILTER (worth > 0) AS matched, round(100 * sum(worth * CASE WHEN required THEN 1.0 ELSE 0.5 END) / sum(CASE WHEN required THEN 1.0 ELSE 0.5 END), 4) AS score
    FROM kinds GROUP BY candidate, job_id"""
)
def skill_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill scores of all candidates for the postings whose title is one of their target roles."""
    listed = table(spark, sf_dir, "skills")
    items = _requirement_items(spark, sf_dir)
    known = skills.resolve(items.select("name").distinct(), listed)
    wanted = items.join(known, "name").groupBy("job_id", "skill").agg(F.first("category").alias("category"), F.max("required").alias("required"))
    people = profiles.profiles(table(spark, sf_dir, "candidate_profile"))
    canonical = listed.filter("is_alias = 0").select(F.col("name").alias("skill"), "category")
    offered = people.select(F.col("id").alias("group"), F.posexplode("skills").alias("place", "skill")).join(canonical, "skill")
    related = spark.createDataFrame([p for a, b in NEIGHBOURS for p in ((a, b), (b, a))], "a string, b string")
    roles = stage(people.select(F.col("id").alias("group"), F.explode("target_roles").alias("on")).distinct(), "roles")
    wanted = stage(wanted.withColumnRenamed("job_id", "key"), "wanted")
    titles = table(spark, sf_dir, "jobs").select(F.col("job_id").alias("key"), F.col("title").alias("on")).join(broadcast_if_small(roles).select("on"), "on", "left_semi").distinct()
    titles = stage(titles.join(wanted, "key", "left_semi"), "titles")
    # An id under several titles, if there is one, may be sought twice by one candidate, and is scored once.
    twice = broadcast_if_small(stage(titles.groupBy("key").count().filter("count > 1").select("key"), "twice"))
    scored = skills.score_pairs(roles, titles.join(twice, "key", "left_anti"), wanted, offered, related)
    again = roles.join(titles.join(twice, "key", "left_semi"), "on").select("group", "key").distinct().join(wanted, "key")
    scored = scored.union(skills.score(skills.match(again, offered, related)))
    return scored.select(F.col("group").alias("candidate_id"), F.col("key").alias("job_id"), "skills", "matched", F.round("score", 4).alias("score"))


@query()
def skill_scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth candidate against all postings with requirements; no skills asked for give the neutral score."""
    listed = table(spark, sf_dir, "skills")
    items = _requirement_items(spark, sf_dir)
    known = skills.resolve(items.select("name").distinct(), listed)
    wanted = items.join(known, "name").groupBy(F.col("job_id").alias("key"), "skill").agg(F.first("category").alias("category"), F.max("required").alias("required"))
    people = profiles.profiles(table(spark, sf_dir, "candidate_profile").filter("id % 100 = 0"))
    canonical = listed.filter("is_alias = 0").select(F.col("name").alias("skill"), "category")
    offered = people.select(F.col("id").alias("group"), F.posexplode("skills").alias("place", "skill")).join(canonical, "skill")
    related = spark.createDataFrame([p for a, b in NEIGHBOURS for p in ((a, b), (b, a))], "a string, b string")
    asking = people.select(F.lit(0).alias("on"), F.col("id").alias("group")).distinct()
    asked = table(spark, sf_dir, "job_requirements").select(F.lit(0).alias("on"), F.col("job_id").alias("key")).distinct()
    scored = skills.score_pairs(asking, asked, wanted, offered, related)
    return scored.select(F.col("group").alias("candidate_id"), F.col("key").alias("job_id"), "skills", "matched", F.round("score", 4).alias("score"))


@query(
    """WITH p AS (SELECT q.vec_id AS query_id, a.vec_id, list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS s
        FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0)
    SELECT query_id, vec_id, round(s, 5) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10"""
)
def cosine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    near = rank.search(vectors, vectors.filter("key % 100 = 0"), 10)
    return near.select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), F.round("similarity", 5).alias("similarity"))


@query(
    r"""WITH t AS (SELECT job_id AS key, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS t FROM jobs),
    g AS (SELECT key, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM t WHERE length(t) >= 3),
    b AS (SELECT key, CAST(('0x' || left(md5(gram), 8))::BIGINT % 256 AS INTEGER) AS bucket, count(*) AS n FROM g GROUP BY ALL),
    v AS (SELECT key, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS weight FROM b),
    s AS (SELECT q.key AS query_id, v.key AS job_id, round(sum(q.weight * v.weight), 6) AS similarity FROM v JOIN v q USING (bucket) WHERE q.key % 100 = 0 GROUP BY q.key, v.key)
    SELECT query_id, job_id, similarity, round(greatest(0, least(100, 100 * (similarity - 0.35) / 0.5)), 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, job_id) <= 20"""
)
def hashed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of every hundredth posting against all, by hashed trigrams."""
    vectors = stage(rank.dense(rank.hashed_grams(table(spark, sf_dir, "jobs").select(F.col("job_id").alias("key"), F.col("title").alias("text")))), "grams")
    near = rank.search(vectors, vectors.filter("key % 100 = 0"), 20, digits=6).filter("similarity > 0")
    return near.select(F.col("query").alias("query_id"), F.col("key").alias("job_id"), "similarity", F.round(rank.rescale(F.col("similarity"), 0.35, 0.85), 4).alias("score"))


WEIGHTS = {"experience_score": 0.30, "skill_score": 0.25, "embedding_score": 0.20, "domain_score": 0.10, "responsibility_score": 0.10, "career_alignment_score": 0.05}


@query(
    "SELECT job_id, created_at, round((" + " + ".join(f"coalesce({c}, 0) * {w}" for c, w in WEIGHTS.items()) + "), 4) AS weighted_score FROM (SELECT DISTINCT * FROM job_matches)"
)
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "job_matches").distinct().select("job_id", "created_at", F.round(rank.weighted(WEIGHTS), 4).alias("weighted_score"))


@query(
    """SELECT job_id, final_score, verdict, config_hash, created_at FROM job_matches
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, config_hash DESC, final_score DESC, verdict DESC) = 1"""
)
def latest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "job_matches").select("job_id", "final_score", "verdict", "config_hash", "created_at")
    return postings.latest(rows, ["job_id"], ["created_at", "config_hash", "final_score", "verdict"])


@query("SELECT m.job_id, j.url, j.title, m.verdict, m.final_score, m.created_at FROM job_matches m JOIN jobs j ON j.job_id = m.job_id")
def matches_with_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs").select("job_id", "url", "title")
    return table(spark, sf_dir, "job_matches").join(jobs, "job_id").select("job_id", "url", "title", "verdict", "final_score", "created_at")


@query("SELECT source, count(*) AS jobs, count(DISTINCT company) AS companies, count(salary) AS with_salary FROM jobs GROUP BY source")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "jobs").groupBy("source").agg(F.count("*").alias("jobs"), F.count_distinct("company").alias("companies"), F.count("salary").alias("with_salary"))


AS_OF = "2025-03-01 00:00:00"


@query(f"SELECT job_id, posted_date FROM jobs WHERE posted_date IS NULL OR posted_date >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY")
def fresh_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.fresh(table(spark, sf_dir, "jobs"), F.expr(f"TIMESTAMP_NTZ '{AS_OF}'"), 14).select("job_id", "posted_date")


_URL = ORACLES["canonical_urls"]
_PAY = ORACLES["pay_texts"]
_DATE = ORACLES["parse_dates"]
_TYPES = "CASE " + " ".join(f"WHEN contains(j, '{t}') THEN '{k}'" for t, k in web.EMPLOYMENT) + " ELSE 'unknown' END"


@query(f"SELECT job_id, last_seen FROM jobs WHERE last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY ORDER BY job_id")
def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen lately, by id: the predicate reaches the scan, the order is a range partitioning."""
    seen = F.col("last_seen") >= F.expr(f"TIMESTAMP_NTZ '{AS_OF}' - INTERVAL '30' DAY")
    return table(spark, sf_dir, "jobs").filter(seen).select("job_id", "last_seen").orderBy("job_id")


@query(
    f"""WITH c AS (SELECT * FROM ({ORACLES["clean_descriptions"]})), u AS (SELECT * FROM ({_URL})), p AS (SELECT * FROM ({_PAY})), d AS (SELECT * FROM ({_DATE})),
    n AS (SELECT r.raw_id, trim(coalesce(company, '')) AS company, trim(coalesce(title, '')) AS title, trim(coalesce(location, '')) AS location, c.description, u.url,
        lower(trim(coalesce(site, ''))) AS source, p.salary, d.posted_date, coalesce(job_level, '') AS job_level_raw, coalesce(experience_range, '') AS experience_range_raw, is_remote, lower(array_to_string(job_type, ' ')) AS j
        FROM raw_posting r JOIN c USING (raw_id) JOIN u USING (raw_id) JOIN p USING (raw_id) JOIN d USING (raw_id) WHERE trim(coalesce(job_url, '')) <> '' AND trim(coalesce(title, '')) <> ''),
    t AS (SELECT *, lower(concat_ws(' ', CASE WHEN is_remote THEN 'remote' END, title, location, left(description, 400))) AS c, lower(concat_ws(' ', title, left(description, 400))) AS e, {_TYPES} AS stated FROM n)
    SELECT raw_id AS ordinal, company, title, location, description, url, source, CASE WHEN source <> '' THEN [source] ELSE [] END AS sources, salary,
        CASE WHEN stated <> 'unknown' THEN stated ELSE {_EMPLOYMENTS} END AS employment_type, {_MODES} AS work_mode, posted_date,
        sha256(lower(trim(regexp_replace(company || '|' || title || '|' || description, '[ \t\n\r\f\v]+', ' ', 'g')))) AS content_hash, job_level_raw, experience_range_raw FROM t"""
)
def normalised_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.normalise(table(spark, sf_dir, "raw_posting"))


@query()
def deduplicated_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against a sequential model."""
    return postings.deduplicate(postings.normalise(table(spark, sf_dir, "raw_posting")))


@query(
    f"""WITH old AS (SELECT url, company, sources, first_seen, last_seen FROM jobs WHERE first_seen < TIMESTAMP '{AS_OF}'),
    new AS (SELECT url, 'seen again' AS company, ['rescan'] AS sources FROM jobs WHERE last_seen >= TIMESTAMP '{AS_OF}' OR first_seen >= TIMESTAMP '{AS_OF}')
    SELECT coalesce(o.url, n.url) AS url, CASE WHEN n.url IS NOT NULL THEN n.company ELSE o.company END AS company, array_to_string(list_distinct(list_concat(coalesce(o.sources, []), coalesce(n.sources, []))).list_sort(), ',') AS sources,
        coalesce(o.first_seen, TIMESTAMP '{AS_OF}') AS first_seen, CASE WHEN n.url IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE o.last_seen END AS last_seen, o.url IS NULL AS is_new FROM old o FULL JOIN new n ON o.url = n.url"""
)
def upserted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known before a day, with what was seen from that day on merged in."""
    as_of = F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")
    jobs = table(spark, sf_dir, "jobs")
    again = jobs.filter((F.col("last_seen") >= as_of) | (F.col("first_seen") >= as_of))
    none = F.lit(None).cast("timestamp_ntz")
    again = again.withColumn("company", F.lit("seen again")).withColumn("sources", F.array(F.lit("rescan"))).withColumn("first_seen", none).withColumn("last_seen", none)
    merged = postings.upsert(jobs.filter(F.col("first_seen") < as_of), again, as_of)
    return merged.select("url", "company", F.array_join(F.array_sort("sources"), ",").alias("sources"), "first_seen", "last_seen", "is_new")


@query(
    """SELECT verdict, experience_fit, count(*) AS matches, count(DISTINCT job_id) AS jobs, round(avg(final_score), 6) AS mean_score, max(final_score) AS best_score FROM job_matches GROUP BY verdict, experience_fit"""
)
def verdict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "job_matches").groupBy("verdict", "experience_fit")
    return rows.agg(F.count("*").alias("matches"), F.count_distinct("job_id").alias("jobs"), F.round(F.avg("final_score"), 6).alias("mean_score"), F.max("final_score").alias("best_score"))


@query(
    """SELECT status, count(*) AS runs, sum(coalesce(CAST(json_extract(stats_json, '$.scraped') AS BIGINT), 0)) AS scraped, sum(coalesce(CAST(json_extract(stats_json, '$.rejected') AS BIGINT), 0)) AS rejected, count(finished_at) AS finished FROM search_runs GROUP BY status"""
)
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.from_json("stats_json", "scraped bigint, rejected bigint")
    rows = table(spark, sf_dir, "search_runs").select("status", "finished_at", s.alias("s")).groupBy("status")
    return rows.agg(F.count("*").alias("runs"), F.sum(F.coalesce("s.scraped", F.lit(0))).alias("scraped"), F.sum(F.coalesce("s.rejected", F.lit(0))).alias("rejected"), F.count("finished_at").alias("finished"))


@query(
    """SELECT id, coalesce(json_extract_string(profile_json, '$.current_title'), '') AS current_title, TRY_CAST(json_extract_string(profile_json, '$.total_experience_years') AS DOUBLE) AS total_years,
        len(list_filter(coalesce(from_json(json_extract(profile_json, '$.skills'), '["VARCHAR"]'), []), lambda s: length(trim(s)) > 0)) AS skills FROM candidate_profile"""
)
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profiles.profiles(table(spark, sf_dir, "candidate_profile"))
    return p.select("id", "current_title", F.col("total_experience_years").alias("total_years"), F.size("skills").alias("skills"))


_LIST = "list_filter(coalesce(from_json(json_extract(profile_json, '$.{0}'), '[\"VARCHAR\"]'), []), lambda s: length(trim(s)) > 0) AS {0}"


@query(
    f"""WITH p AS (SELECT id, {_LIST.format("target_roles")}, {_LIST.format("core_skills")}, {_LIST.format("skills")} FROM candidate_profile),
    l AS (SELECT id, list_concat(target_roles, list_transform(CASE WHEN len(core_skills) > 0 THEN core_skills ELSE skills END, lambda s: s || ' Engineer')) AS l FROM p),
    u AS (SELECT id, unnest(l) AS query, unnest(range(1, len(l) + 1)) AS n FROM l), d AS (SELECT id, query, min(n) AS n FROM u GROUP BY id, query)
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) AS INTEGER) AS place, query FROM d QUALIFY place <= 6
    UNION ALL SELECT id, place, query FROM l, (VALUES (1, 'Data Analyst'), (2, 'Software Engineer')) v(place, query) WHERE len(l.l) = 0"""
)
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.search_queries(profiles.profiles(table(spark, sf_dir, "candidate_profile")))


@query("SELECT fingerprint, model, arg_max(profile_json, id) AS profile_json, max(id) AS id FROM candidate_profile GROUP BY fingerprint, model")
def latest_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "candidate_profile").select("fingerprint", "model", "profile_json", "id")
    return postings.latest(rows, ["fingerprint", "model"], ["id"])


@query(
    r"""SELECT event_id, TRY_CAST(regexp_extract(props, '-?\d+(?:\.\d+)?') AS DOUBLE) AS number, CAST(greatest(0, least(100, coalesce(TRY_CAST(regexp_extract(props, '-?\d+(?:\.\d+)?') AS DOUBLE), 0))) AS INTEGER) AS score FROM events"""
)
def coerced_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", coerce.to_number(F.col("props")).alias("number"), coerce.to_score(F.col("props")).alias("score"))


@query(
    r"""SELECT doc_id, length(text) AS characters, regexp_matches(text, '(?i)requirements?|qualifications?|what you.{0,20}bring|skills? needed|responsibilit(?:y|ies)|what you.{0,20}do|about the role|your profile') AS has_section,
    CASE WHEN length(text) <= 600 THEN text ELSE NULL END AS short_text FROM documents WHERE text IS NOT NULL"""
)
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    whole = text.excerpt(F.col("text"), 600)
    return docs.select("doc_id", F.length("text").alias("characters"), F.col("text").rlike(text.SECTION).alias("has_section"), F.when(F.length("text") <= 600, whole).alias("short_text"))


def sql_excerpt(t: str, size: int) -> str:
    pattern = quoted(text.SECTION)
    at = f"strpos({t}, regexp_extract({t}, '{pattern}'))"
    start = f"greatest(1, {at} - {size // 4})"
    return f"""CASE WHEN length({t}) <= {size} THEN {t} WHEN regexp_matches({t}, '{pattern}') AND {at} - 1 < length({t}) - 100
        THEN left(substr({t}, {start}, {at} - {start}) || chr(10) || substr({t}, {at}, {size}), {size + size // 4}) ELSE left({t}, {size}) END"""


@query(f"SELECT doc_id, {sql_excerpt('text', 600)} AS excerpt FROM documents WHERE text IS NOT NULL")
def section_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of all documents, long ones too; tested against a small model."""
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", text.excerpt(F.col("text"), 600).alias("excerpt"))


@query(
    """SELECT n_name AS nation, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY n_name"""
)
def star_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join of the driver's tables, to see pushdown and join order."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'")).select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


MATCHED = ("MATCH", "BORDERLINE")


@query(
    """SELECT m.job_id, j.company, j.title, m.verdict, m.final_score, strftime(j.posted_date, '%Y-%m-%d') AS posted, array_to_string(j.sources, ', ') AS platform, CAST(row_number() OVER (ORDER BY CASE m.verdict WHEN 'MATCH' THEN 0 ELSE 1 END, m.final_score DESC, m.job_id) AS INTEGER) AS place
    FROM (SELECT * FROM job_matches QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, config_hash DESC, final_score DESC, verdict DESC) = 1) m JOIN jobs j ON j.job_id = m.job_id WHERE m.verdict IN ('MATCH', 'BORDERLINE')
    QUALIFY place <= 1000"""
)
def matched_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's first thousand rows: verdict, then score."""
    rows = table(spark, sf_dir, "job_matches").select("job_id", "final_score", "verdict", "config_hash", "created_at")
    best = postings.latest(rows, ["job_id"], ["created_at", "config_hash", "final_score", "verdict"]).filter(F.col("verdict").isin(*MATCHED))
    jobs = table(spark, sf_dir, "jobs").select("job_id", "company", "title", "posted_date", "sources")
    order = [F.when(F.col("verdict") == "MATCH", 0).otherwise(1), F.desc("final_score"), F.asc("job_id")]
    shown = best.join(jobs, "job_id").orderBy(*order).limit(1000)
    shown = shown.withColumn("place", F.row_number().over(W.orderBy(*order)))  # at most a thousand rows
    return shown.select("job_id", "company", "title", "verdict", "final_score", F.date_format("posted_date", "yyyy-MM-dd").alias("posted"), F.array_join("sources", ", ").alias("platform"), "place")


@query()
def matched_report_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report; a row's place is its number in its range of the order, after the counts of the ranges before."""
    rows = table(spark, sf_dir, "job_matches").select("job_id", "final_score", "verdict", "config_hash", "created_at")
    best = postings.latest(rows, ["job_id"], ["created_at", "config_hash", "final_score", "verdict"]).filter(F.col("verdict").isin(*MATCHED))
    jobs = table(spark, sf_dir, "jobs").select("job_id", "company", "title", "posted_date", "sources")
    order = [F.when(F.col("verdict") == "MATCH", 0).otherwise(1), F.desc("final_score"), F.asc("job_id")]
    shown = stage(best.join(jobs, "job_id").repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "report")
    counts = shown.groupBy("range").count()  # a row per range
    ahead = counts.select("range", (F.sum("count").over(W.orderBy("range")) - F.col("count")).alias("ahead"))
    shown = shown.withColumn("nth", F.row_number().over(W.partitionBy("range").orderBy(*order))).join(F.broadcast(ahead), "range")
    place = (F.col("ahead") + F.col("nth")).alias("place")
    return shown.select("job_id", "company", "title", "verdict", "final_score", F.date_format("posted_date", "yyyy-MM-dd").alias("posted"), F.array_join("sources", ", ").alias("platform"), place)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings per level, mode and domain of experience, with the years asked for."""
    jobs = table(spark, sf_dir, "jobs").withColumn("x", experience.experience(F.col("description")))
    start = F.substr("description", F.lit(1), F.lit(400))
    keyed = jobs.select(
        detect.seniority(F.col("title")).alias("seniority"),
        detect.work_mode(F.col("title"), F.col("location"), start).alias("work_mode"),
        experience.domain_of(F.col("x.sentence"), F.col("title")).alias("experience_domain"),
        F.col("x.min_years").alias("min_years"),
    )
    return keyed.groupBy("seniority", "work_mode", "experience_domain").agg(F.count("*").alias("jobs"), F.avg("min_years").alias("mean_years"))
