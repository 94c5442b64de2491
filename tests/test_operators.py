from __future__ import annotations

import random

from pyspark.sql import functions as F

from vocandra.operators import postings, profiles, rank, skills, units

POSTING = "ordinal long, company string, title string, location string, description string, url string, source string, sources array<string>, salary string, employment_type string, work_mode string, posted_date timestamp_ntz, content_hash string, job_level_raw string, experience_range_raw string"


def posting(i, url, company="A", title="T", location="L", description="d", source="s", work_mode="unknown"):
    return (i, company, title, location, description, url, source, [source], "", "unknown", work_mode, None, f"h{i}", "", "")


def sequential(rows):
    """The rule by the book: in order, a row is merged if a kept row holds its url, or else its fuzzy key."""
    by_url, by_fuzzy, holder = {}, {}, {}
    for i, u, f in rows:
        if u in by_url:
            holder[i] = by_url[u]
        elif f in by_fuzzy:
            holder[i] = by_fuzzy[f]
        else:
            by_url[u], by_fuzzy[f], holder[i] = i, i, i
    return holder


def test_holders_follow_the_sequential_rule(spark):
    rng = random.Random(1)
    for n in (1, 40, 80):
        rows = [(i, f"u{rng.randrange(n)}", f"f{rng.randrange(n)}") for i in range(n)]
        got = {r["ordinal"]: r["holder"] for r in postings.holders(spark.createDataFrame(rows, "ordinal long, url_key string, fuzzy_key string")).collect()}
        assert got == sequential(rows)


def test_deduplicate_merges(spark):
    rows = [
        posting(1, "u1", company="NVIDIA Inc", description="short", source="a"),
        posting(2, "u2", company="Nvidia", description="much longer", source="b", work_mode="remote"),
        posting(3, "u3", company="Nvidia", location="elsewhere"),
    ]
    got = {r["holder"]: r for r in postings.deduplicate(spark.createDataFrame(rows, POSTING)).collect()}
    assert set(got) == {1, 3}
    assert got[1]["sources"] == ["a", "b"] and got[1]["description"] == "much longer" and got[1]["content_hash"] == "h2" and got[1]["work_mode"] == "remote"
    assert postings.deduplicate(spark.createDataFrame([], POSTING)).count() == 0


def test_upsert(spark):
    schema = "url string, company string, title string, location string, description string, sources array<string>, salary string, employment_type string, work_mode string, content_hash string, first_seen timestamp_ntz, last_seen timestamp_ntz"
    old = spark.createDataFrame([("u1", "A", "T", "L", "text", ["a"], "10", "full_time", "remote", "h1", None, None)], schema)
    new = spark.createDataFrame([("u1", "B", "T2", "L", "", ["b"], "", "", "hybrid", "h2", None, None), ("u2", "C", "T", "L", "x", ["c"], "", "", "", "h3", None, None)], schema)
    got = {r["url"]: r for r in postings.upsert(old, new, F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00'")).collect()}
    u1 = got["u1"]
    assert (u1["company"], u1["description"], u1["salary"], u1["employment_type"], u1["work_mode"], u1["content_hash"]) == ("B", "text", "10", "full_time", "hybrid", "h1")
    assert u1["sources"] == ["a", "b"] and not u1["is_new"] and got["u2"]["is_new"]


TAXONOMY = [(1, "Python", "CODING", 0, 1), (2, "Deep learning", "LEARNING", 0, 2), (3, "Torvanet", "LEARNING", 0, 3), (4, "Edge inference", "DEPLOY", 0, 4), (5, "py", "CODING", 1, 1), (6, "torva net", "LEARNING", 1, 3)]


def test_skills(spark):
    table = spark.createDataFrame(TAXONOMY, "id long, name string, category string, is_alias int, canonical_id long")
    texts = spark.createDataFrame([(1, "We use Torva Net, python & deep-learning."), (2, None), (3, "")], "key long, text string")
    found = {(r["key"], r["skill"]) for r in skills.scan(texts, table).collect()}
    assert found == {(1, "Torvanet"), (1, "Python"), (1, "Deep learning")}
    names = spark.createDataFrame([("PY",), ("strong torva net",), ("Knitting  well",)], "name string")
    known = {r["name"]: r["skill"] for r in skills.resolve(names, table).collect()}
    assert known == {"PY": "Python", "strong torva net": "Torvanet", "Knitting  well": "Knitting well"}
    wanted = spark.createDataFrame([(1, 7, "Python", "CODING", True), (1, 7, "Deep learning", "LEARNING", True), (1, 7, "Edge inference", "DEPLOY", False), (1, 7, "Knitting", None, False)], "group long, key long, skill string, category string, required boolean")
    offered = spark.createDataFrame([(1, "Python", "CODING", 1), (1, "Torvanet", "LEARNING", 2)], "group long, skill string, category string, place int")
    related = spark.createDataFrame([("DEPLOY", "LEARNING"), ("LEARNING", "DEPLOY")], "a string, b string")
    kinds = skills.match(wanted, offered, related)
    assert {r["skill"]: r["kind"] for r in kinds.collect()} == {"Python": "exact", "Deep learning": "related", "Edge inference": "transferable", "Knitting": "missing"}
    assert abs(skills.score(kinds).first()["score"] - 100 * (1 + 0.75 + 0.25) / 3) < 1e-9


def test_rank(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = row.select(rank.cosine(F.col("a"), F.col("b")).alias("x"), rank.cosine(F.col("a"), F.col("z")).alias("y"), rank.rescale(F.lit(0.5), 0.35, 0.85).alias("r"), rank.rescale(F.lit(0.5), 1, 1).alias("s")).first()
    assert abs(got["x"] - 2**-0.5) < 1e-9 and got["y"] == 0 and abs(got["r"] - 30) < 1e-9 and got["s"] == 50
    texts = spark.createDataFrame([(1, "abc"), (2, "ab"), (3, None)], "key long, text string")
    grams = rank.hashed_grams(texts).collect()
    assert [(r["key"], r["weight"]) for r in grams] == [(1, 1.0)]


def test_search_equals_brute_force(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)] + [(500, [0.0] * 6), (501, [1.0] * 6), (502, [1.0] * 6)]
    frame = spark.createDataFrame(vectors, "key long, vector array<double>").repartition(3)
    got = {(r["query"], r["key"]) for r in rank.search(frame, frame.filter("key % 25 = 0"), 5, block=2).collect()}
    size = lambda v: sum(x * x for x in v) ** 0.5
    for q, v in vectors:
        if q % 25 == 0:
            share = {k: (sum(a * b for a, b in zip(v, w)) / (size(v) * size(w)) if size(v) * size(w) else 0.0) for k, w in vectors}
            want = sorted(share, key=lambda k: (-round(share[k], 9), k))[:5]
            assert {k for a, k in got if a == q} == set(want)


def test_profiles(spark):
    rows = spark.createDataFrame([(1, '{"name": "A B", "skills": ["x", ""], "total_experience_years": "60", "experience_by_domain": {"ml": -1, "cv": 2}}'), (2, None), (3, "no json")], "id long, profile_json string")
    got = {r["id"]: r for r in profiles.profiles(rows).collect()}
    assert got[1]["skills"] == ["x"] and got[1]["total_experience_years"] is None and got[1]["experience_by_domain"] == {"cv": 2.0}
    assert got[2]["name"] == "" and got[3]["skills"] == []
    resume = spark.createDataFrame([("Ann Lee\nann@x.org\nI have 4 years of experience.\nIn all 10+ yrs of experience, 99 years old",)], "t string")
    said = resume.select(profiles.resume_name(F.col("t")).alias("n"), profiles.resume_years(F.col("t")).alias("y")).first()
    assert (said["n"], said["y"]) == ("Ann Lee", 10.0)


UNITS = [("hour", "period", 2080), ("day", "period", 260), ("week", "period", 52), ("fortnight", "period", 26), ("month", "period", 12), ("quarter", "period", 4), ("year", "period", 1), ("thousand", "scale", 1000), ("lakh", "scale", 100000), ("million", "scale", 1000000), ("crore", "scale", 10000000)]


def test_annual_pay(spark):
    cases = [
        ("USD 62,000-82,000 yearly", "", ("USD", 62000, 82000)),
        ("€2.67 thousand pcm", "", ("EUR", 32040, 32040)),
        ("EUR142.000–155.000 p.a.", "", ("EUR", 142000, 155000)),
        ("₹22.5L p.a.", "", ("INR", 2250000, 2250000)),
        ("25-30.4 LPA INR", "", ("INR", 2500000, 3040000)),
        ("5,00,000 INR per year", "", ("INR", 500000, 500000)),
        ("Pay €46,25 to 59,75 p/h + bonus", "", ("EUR", 96200, 124280)),
        ("up to $865 every two weeks", "", ("USD", 22490, 22490)),
        ("Rs. 0.31 - 0.459 Cr p.a.", "", ("INR", 3100000, 4590000)),
        ("110 to 163.5", "(USD, thousand each year, before tax) Requirements: 3 months", ("USD", 110000, 163500)),
        ("41", "All pay figures on this page are euros per hour.", ("EUR", 85280, 85280)),
        ("USD 149,000", "", None),
        ("Bonus up to 10%", "", None),
        ("0", "All pay figures on this page are euros per hour.", None),
        ("47-111", "We pay well.", None),
        ("", "", None),
        (None, None, None),
    ]
    jobs = spark.createDataFrame([(i, s, d) for i, (s, d, _) in enumerate(cases)], "job_id long, salary string, description string")
    got = {r["job_id"]: (r["currency"], r["annual_min"], r["annual_max"]) for r in units.annual_pay(jobs, spark.createDataFrame(UNITS, "unit string, kind string, factor long")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases) if want}
    empty = units.annual_pay(jobs.limit(0), spark.createDataFrame(UNITS, "unit string, kind string, factor long"))
    assert empty.count() == 0


def test_notations_are_learned_from_linked_postings(spark):
    line = "a line long enough to link the copies of this posting number {} by its hash, and more words"
    rows = []
    for i in range(12):
        rows.append((2 * i, f"USD {1000 * (i + 3)} monthly", line.format(i)))
        rows.append((2 * i + 1, f"USD {12 * (i + 3)} kay annus", line.format(i)))
    pay = units.read_pay(spark.createDataFrame(rows, "job_id long, salary string, description string"))
    got = {r["notation"]: (r["factor"], r["learned"]) for r in units.notation_factors(pay, spark.createDataFrame(UNITS, "unit string, kind string, factor long")).collect()}
    assert got["kay annus"] == (1000, True)


def test_notations_are_learned_from_lines_of_many_postings(spark):
    """A posting that came again more often than ``FEW`` times teaches as well; rarer lines come first."""
    line = "a line long enough to link the copies of this posting number {} by its hash, and more words"
    rows = []
    for i in range(6):
        for again in range(units.FEW):
            rows.append((len(rows), f"USD {1000 * (i + 3)} monthly", line.format(f"0{i}")))
            rows.append((len(rows), f"USD {12 * (i + 3)} kay annus", line.format(f"0{i}")))
    pay = units.read_pay(spark.createDataFrame(rows, "job_id long, salary string, description string"))
    got = {r["notation"]: (r["factor"], r["learned"]) for r in units.notation_factors(pay, spark.createDataFrame(UNITS, "unit string, kind string, factor long")).collect()}
    assert got["kay annus"] == (1000, True)
    assert {r["level"] for r in units.notation_pairs(pay).collect()} == {1}
