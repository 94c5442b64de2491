from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vocandra.functions import coerce, detect, registered, text
from vocandra.operators import places, rank, requirements, resumes, skills
from vocandra.sources import config, sinks

TAXONOMY = [(1, "Python", "CODING", 0, 1), (2, "Deep learning", "DEEP_LEARNING", 0, 2), (3, "Object detection", "COMPUTER_VISION", 0, 3), (4, "py", "CODING", 1, 1), (5, "large scale near duplicate text search", "DATA", 0, 5)]
SKILLS = "id long, name string, category string, is_alias int, canonical_id long"
JOBS = "job_id long, title string, location string, description string, employment_type string, work_mode string, job_level_raw string"


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame(TAXONOMY, SKILLS)


def test_extracted_requirements(spark, taxonomy):
    jobs = [
        (1, "Engineer", "remote", "Requirements: 3-5 years of experience in machine learning. We use Python and deep learning.", "", "", "Director"),
        (2, "Senior Engineer", "", "Great team.", "full-time", "onsite", "entry"),
        (3, "", None, None, None, None, None),
    ]
    got = {r["job_id"]: r for r in requirements.extracted(spark.createDataFrame(jobs, JOBS), taxonomy).collect()}
    a, b, c = got[1], got[2], got[3]
    assert (a["min_experience_years"], a["max_experience_years"], a["experience_domain"], a["experience_confidence"]) == (3, 5, "machine_learning", 0.7)
    assert (a["seniority"], a["work_mode"], a["extraction_method"]) == ("manager", "remote", "regex")
    assert set(a["required_skills"]) == {"Python", "Deep learning"} and a["preferred_skills"] == [] and a["experience_text"].startswith("Requirements: 3-5")
    assert (b["seniority"], b["employment_type"], b["work_mode"], b["extraction_method"], b["experience_confidence"]) == ("senior", "full_time", "onsite", "none", 0.0)
    assert (c["seniority"], c["experience_text"], c["experience_domain"]) == ("unknown", "", "general")


def test_merged_requirements_and_fingerprints(spark):
    schema = "job_id long, min_experience_years double, max_experience_years double, experience_text string, experience_domain string, experience_confidence double, required_skills array<string>, preferred_skills array<string>, seniority string, employment_type string, work_mode string, responsibilities array<string>, extraction_method string"
    row = lambda i, low, domain, confidence, level, by: (i, low, None, f"text {by}", domain, confidence, [by], [], level, "unknown", by, [by], by)
    rules = spark.createDataFrame([row(1, 3.0, "nlp", 0.7, "senior", "regex"), row(2, 3.0, "general", 0.7, "unknown", "regex"), row(3, None, "general", 0.0, "mid", "none")], schema)
    model = spark.createDataFrame([row(1, None, "general", 0.9, "mid", "llm"), row(2, 5.0, "mlops", 0.5, "lead", "llm")], schema)
    got = {r["job_id"]: r for r in requirements.merged(rules, model).collect()}
    assert (got[1]["min_experience_years"], got[1]["experience_confidence"], got[1]["experience_text"], got[1]["experience_domain"], got[1]["seniority"]) == (3.0, 0.7, "text regex", "nlp", "senior")
    assert (got[2]["min_experience_years"], got[2]["experience_domain"], got[2]["seniority"], got[2]["required_skills"], got[2]["extraction_method"]) == (5.0, "mlops", "lead", ["llm"], "merged")
    assert abs(got[2]["experience_confidence"] - 0.63) < 1e-9 and got[3]["extraction_method"] == "none"
    marks = [r["f"] for r in rules.select(requirements.fingerprint(rules).alias("f")).collect()]
    same = rules.withColumn("responsibilities", F.array(F.lit("other")))
    assert [r["f"] for r in same.select(requirements.fingerprint(same).alias("f")).collect()] == marks and len(set(marks)) == 3
    other = rules.withColumn("work_mode", F.lit("x"))
    assert not {r["f"] for r in other.select(requirements.fingerprint(other).alias("f")).collect()} & set(marks)


def test_posting_text(spark):
    schema = "title string, company string, location string, work_mode string, description string, required_skills array<string>, preferred_skills array<string>, min_experience_years double, max_experience_years double, experience_domain string, responsibilities array<string>"
    rows = spark.createDataFrame([("T", "C", "L", "remote", "Some text", ["a"], ["b"], 3.0, None, "machine_learning", ["x", "y"]), (None,) * 11], schema)
    full, empty = [r["t"] for r in rows.select(requirements.posting_text(100).alias("t")).collect()]
    assert full == "TITLE: T\nCOMPANY: C\nLOCATION: L | WORK MODE: remote\nSKILLS: a, b\nEXPERIENCE: 3+ years in machine learning\nRESPONSIBILITIES: x; y\nDOMAIN: machine learning\nDESCRIPTION: Some text"
    assert "EXPERIENCE: not specified in general" in empty


RESUME = """Ann Lee
Senior Machine Learning Engineer
ann@x.org

Professional Summary
Engineer with 10+ years of experience, of which 4 years in machine
learning and 3 yrs of computer vision for shops and yards.
SKILLS
Python, object detection, deep learning
Target Roles:
- Vision Engineer, ML Engineer
- Gardener

Excluded roles
Telecom Engineer, Network Engineer
Education
Remote preferred.
"""


def test_resume_profiles(spark, taxonomy):
    texts = spark.createDataFrame([(1, RESUME), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: r for r in resumes.read_resumes(texts, taxonomy).collect()}
    r = got[1]
    assert (r["name"], r["current_title"]) == ("Ann Lee", "Senior Machine Learning Engineer")
    assert (r["total_experience_years"], r["relevant_experience_years"]) == (10.0, 4.0)
    assert r["experience_by_domain"] == {"machine_learning": 4.0, "computer_vision": 3.0}
    assert set(r["skills"]) == {"Python", "Object detection", "Deep learning"} and r["core_skills"] == r["skills"] and r["secondary_skills"] == []
    assert r["target_roles"] == ["Vision Engineer", "ML Engineer"] and r["excluded_roles"] == ["Telecom Engineer", "Network Engineer"]
    assert r["locations"] == ["Remote"] and r["summary"].startswith("Engineer with 10+ years")
    for i in (2, 3):
        assert (got[i]["name"], got[i]["total_experience_years"], got[i]["skills"], got[i]["target_roles"]) == ("", 0.0, [], list(resumes.DEFAULT_ROLES))


def test_completed_profiles(spark, taxonomy):
    from vocandra.operators.profiles import profiles

    docs = [
        (1, '{"current_title": "Engineer", "skills": ["py", "Python", "juggling"], "core_skills": ["Object Detection"], "relevant_experience_years": 6}'),
        (2, '{"target_roles": [" Baker "], "total_experience_years": 3, "relevant_experience_years": 9}'),
        (3, None),
    ]
    got = {r["id"]: r for r in resumes.completed(profiles(spark.createDataFrame(docs, "id long, profile_json string")), taxonomy).collect()}
    assert got[1]["skills"] == ["Python", "juggling", "Object detection"] and got[1]["core_skills"] == ["Object detection"]
    assert got[1]["target_roles"] == ["Engineer", "Computer Vision Engineer"] and (got[1]["total_experience_years"], got[1]["inferred_seniority"]) == (6.0, "senior")
    assert got[2]["target_roles"] == ["Baker"] and (got[2]["total_experience_years"], got[2]["relevant_experience_years"]) == (3.0, 3.0)
    assert got[3]["target_roles"] == list(resumes.DEFAULT_ROLES) and got[3]["skills"] == []


@pytest.mark.parametrize("raw, level", [("Internship", "intern"), ("associate ", "junior"), ("Mid-Senior level", "senior"), ("Executive", "manager"), ("", "mid"), (None, "mid")])
def test_raw_levels(spark, raw, level):
    assert spark.createDataFrame([(raw,)], "x string").select(requirements.raw_level(F.col("x"))).first()[0] == level


def test_rank_gap(spark):
    rows = spark.createDataFrame([("senior", "mid"), ("unknown", "mid")], "a string, b string")
    assert [r[0] for r in rows.select(detect.rank_gap(F.col("a"), F.col("b"))).collect()] == [1, 0]
    titles = spark.createDataFrame([("ML Engineer", "engineer, data"), ("Baker", "Cook"), (None, "x")], "a string, b string")
    assert [r[0] for r in titles.select(detect.shares_words(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_entities(spark):
    cases = {"a &amp; b": "a & b", "&amp;lt;": "&lt;", "&#8364; &#x20AC; &#128640;": "€ € 🚀", "&eacute;t&eacute;": "été", "&nosuch; &#0; &#xD800;": "&nosuch; &#0; &#xD800;", "no entity; & none": "no entity; & none", "&lt;b&gt;": "<b>", "": ""}
    frame = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r["t"]: r["x"] for r in frame.select("t", text.unescape(F.col("t")).alias("x")).collect()} == cases


def test_functions_by_sql_names(spark):
    assert "rescaled" in registered.register(spark)
    row = spark.sql("SELECT first_number('4+ years') AS n, plain_number(5D) AS p, rescaled(0.5D, 0.35D, 0.85D) AS r, salvaged_json('x {\"a\": 1,}') AS j").first()
    assert (row["n"], row["p"], row["j"]) == (4.0, "5", '{"a": 1}') and abs(row["r"] - 30) < 1e-9


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    from vocandra.streaming.arrivals import upsert_batches

    schema = "raw_id long, site string, title string, company string, job_url string, location string, description string, date_posted string, job_type array<string>, min_amount double, max_amount double, currency string, pay_interval string, is_remote boolean, job_level string, experience_range string, scraped_at timestamp_ntz"
    for k in (1, 2):
        batch = spark.createDataFrame([(k, "s", "T", f"C{k}", f"https://x.org/{k}", "L", "d", *[None] * 10)], schema).withColumn("scraped_at", F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00'"))
        upsert_batches(sinks.KeyedTable(spark, f"file://{tmp_path}/jobs"))(batch, k)
    assert {r["url"] for r in sinks.KeyedTable(spark, f"file://{tmp_path}/jobs").read().collect()} == {"https://x.org/1", "https://x.org/2"}


@pytest.mark.parametrize(
    "answer, found",
    [
        ('{"a": "he said “hi”"}', '{"a": "he said “hi”"}'),
        ('note { here is {"b": 2}', '{"b": 2}'),
        ('{“a”: [1, 2,],}', '{"a": [1, 2]}'),
        ('{"a": {"b": 1},} trailing', '{"a": {"b": 1}}'),
        ("[1, 2]", None),
    ],
)
def test_objects_in_answers(answer, found):
    assert coerce.json_object(answer) == found


def test_long_spellings_are_found_by_automaton_and_join(spark, taxonomy):
    texts = spark.createDataFrame([(1, "We do large-scale near duplicate text search in Python. " * 3), (2, None), (3, "pythonic")], "key long, text string")
    by_automaton, by_join = ({(r["key"], r["skill"], r["place"]) for r in skills.scan(texts, taxonomy, sent=sent).collect()} for sent in (skills.SENT_BYTES, 0))
    assert by_automaton == by_join == {(1, "large scale near duplicate text search", 1), (1, "Python", 2)}
    names = spark.createDataFrame([("fast large scale near duplicate text search",)], "name string")
    assert skills.resolve(names, taxonomy).first()["skill"] == "large scale near duplicate text search"
    assert skills.scan(texts.limit(0), taxonomy).count() == 0 and skills.scan(texts, taxonomy.limit(0)).count() == 0


def test_kinds_of_match(spark):
    kinds = spark.createDataFrame([(1, 7, "b", "exact"), (1, 7, "a", "exact"), (1, 7, "c", "related"), (1, 7, "d", "missing")], "group long, key long, skill string, kind string")
    row = skills.by_kind(kinds).first()
    assert (row["exact"], row["related"], row["transferable"], row["missing"]) == (["a", "b"], ["c"], [], ["d"])
    assert [r["skill"] for r in skills.unmet(kinds).collect()] == ["d"]
    assert {r["skill"] for r in skills.unmet(kinds, "exact").collect()} == {"c", "d"}


def test_located(spark):
    listed = spark.createDataFrame([(1, "Bangalore", ["Bengaluru"], "Karnataka", "India", "KA"), (2, "Delhi", ["Gurugram"], "Haryana", "India", "HR")], "place_id long, name string, alt_names array<string>, region string, country string, site_code string")
    cases = {"Bengaluru, Karnataka, India": "Bangalore", "Gurugram, Haryana": "Delhi", "Work From Home": "remote", "KA": "karnataka", "somewhere in India": "india", "Haryana": "haryana", " Nowhere  Town ": "nowhere town", "": "", None: ""}
    values = spark.createDataFrame([(c,) for c in cases], "value string")
    assert {r["value"]: r["place"] for r in places.located(values, listed).collect()} == cases


def test_embedders(spark):
    texts = spark.createDataFrame([(1, "abcd"), (2, None)], "key long, text string")
    hashed = {r["key"]: r["vector"] for r in rank.embed(texts).collect()}
    assert abs(sum(x * x for x in hashed[1]) - 1) < 1e-9 and len(hashed[1]) == rank.DIMENSIONS
    rank.register_batches("lengths", lambda texts: [[len(t), 1.0] for t in texts])
    own = {r["key"]: r["vector"] for r in rank.embed(texts, "lengths").collect()}
    assert own[2] == [0.0, 1.0] and abs(own[1][0] - 4 / 17**0.5) < 1e-9
    with pytest.raises(KeyError):
        rank.embed(texts, "unknown")


def test_settings(tmp_path):
    told: list[str] = []
    (tmp_path / "s.json").write_text('{"matching": {"high": 70, "weights": {"a": 2, "b": 2}}, "colour": "red"}')
    defaults = {"matching": {"high": 75, "low": 60, "weights": {}, "level": "related"}, "places": ["x"]}
    rules = {"matching.high": ("above", "matching.low"), "matching.level": ("one of", ("exact", "related")), "matching.weights": ("sums to", 1.0)}
    got = config.load_config(defaults, str(tmp_path / "s.json"), {"matching.low": 50, "places": ("y", "z")}, rules, told.append)
    assert got == {"matching": {"high": 70, "low": 50, "weights": {"a": 2, "b": 2}, "level": "related"}, "places": ["y", "z"]}
    assert told[0] == "unknown setting: colour" and "4.000" in told[1] and config.shares({"a": 2, "b": 2}) == {"a": 0.5, "b": 0.5}
    for bad in ({"matching.low": 80}, {"matching.level": "near"}):
        with pytest.raises(ValueError):
            config.load_config(defaults, None, bad, rules, told.append)
    config.load_config(defaults, str(tmp_path / "none.json"), said=told.append)
    assert "none.json" in told[-1]
    a = config.config_hash({"m": 1, "paths": {"out": "x"}}, ("paths.out",))
    assert a == config.config_hash({"paths": {"out": "y"}, "m": 1}, ("paths.out",)) != config.config_hash({"m": 1, "paths": {}}, ("paths.out",), version=4)


def test_tables_are_found_again(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.KeyedTable(spark, path).put(spark.createDataFrame([(1, "a")], "k long, v string"), ["k"])
    later = sinks.KeyedTable(spark, path)
    later.put(spark.createDataFrame([(2, "b")], "k long, v string"), ["k"])
    later.add_missing(spark.createDataFrame([(3, "z", 2), (3, "y", 1), (2, "no", 0)], "k long, v string, at int"), ["k"], F.col("at")) if "at" in later.read().columns else later.add_missing(spark.createDataFrame([(3, "z"), (2, "no")], "k long, v string"), ["k"])
    assert {tuple(r) for r in sinks.KeyedTable(spark, path).read().collect()} == {(1, "a"), (2, "b"), (3, "z")}
    log = sinks.RunLog(sinks.KeyedTable(spark, f"file://{tmp_path}/runs"))
    first, second = log.start({"sites": ["a"]}), log.start({})
    sinks.RunLog(sinks.KeyedTable(spark, f"file://{tmp_path}/runs")).finish(first, {"scraped": 3})
    rows = {r["id"]: r for r in log.table.read().collect()}
    assert (first, second) == (1, 2) and rows[1]["status"] == "finished" and rows[1]["stats_json"] == '{"scraped": 3}' and rows[2]["status"] == "running" and rows[2]["finished_at"] is None


def test_first_row_of_a_key_wins(spark, tmp_path):
    store = sinks.KeyedTable(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([(1, "late", 9), (1, "early", 2), (2, "only", 5)], "k long, v string, at int")
    assert {r["v"] for r in store.add_missing(rows, ["k"], F.col("at")).collect()} == {"early", "only"}


def test_documents_and_caches(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, [1.5])], "id long, name string, x array<double>")
    back = sinks.from_documents(sinks.as_documents(rows, "id"), "id", "name string, x array<double>", {"name": ""})
    assert {r["id"]: (r["name"], r["x"]) for r in back.collect()} == {1: ("a", None), 2: ("", [1.5])}
    now = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, None)], "id long, content string")
    cache = spark.createDataFrame([(1, "h1", 10), (2, "old", 20), (3, None, 30)], "id long, content string, answer int")
    hit, miss = sinks.valid_in_cache(now, cache, "id", ["content"])
    assert {(r["id"], r["answer"]) for r in hit.collect()} == {(1, 10), (3, 30)} and [r["id"] for r in miss.collect()] == [2]
