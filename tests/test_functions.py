from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vocandra.functions import coerce, detect, experience, text, web


def one(spark, column_of, *values, types=None):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types or ["string"] * len(values)))
    return spark.createDataFrame([tuple(values)], schema).select(column_of(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        (None, ""),
        ("&lt;b&gt;Hi&lt;/b&gt; &amp; you", "Hi & you"),
        ("a<br>b\r\nc\n\n\n\nd", "a b\n\nc\n\nd"),
        ("x • one • two", "x\n- one\n- two"),
    ],
)
def test_clean_description(spark, raw, clean):
    assert one(spark, text.clean_description, raw) == clean


@pytest.mark.parametrize(
    "url, canonical",
    [
        ("HTTPS://WWW.Site.com/View/?utm_source=x&jk=Ab1#top", "https://site.com/View?jk=Ab1"),
        ("https://site.com/job/", "https://site.com/job"),
        ("no url", "no url"),
        (None, ""),
    ],
)
def test_canonical_url(spark, url, canonical):
    assert one(spark, web.canonical_url, url) == canonical


def test_dates_take_the_day_first(spark):
    assert str(one(spark, web.parse_date, "03/04/2026")) == "2026-04-03 00:00:00"
    assert str(one(spark, web.parse_date, "12/25/2025")) == "2025-12-25 00:00:00"
    assert one(spark, web.parse_date, "soon") is None


@pytest.mark.parametrize(
    "title, level",
    [("Junior Engineer", "junior"), ("Engineer", "mid"), ("Sr. Engineer", "senior"), ("Staff Engineer", "staff"), ("Principal Engineer", "principal"), ("Lead Engineer", "lead"), ("Engineering Manager, ML", "manager"), ("Engineer Intern", "intern"), ("Engineer II", "mid"), ("Engineer III", "senior"), ("", "unknown")],
)
def test_seniority(spark, title, level):
    assert one(spark, detect.seniority, title) == level


@pytest.mark.parametrize("years, level", [(0.5, "entry"), (3.0, "mid"), (6.0, "senior"), (10.0, "lead"), (13.0, "staff"), (0.0, "unknown")])
def test_seniority_from_years(spark, years, level):
    assert one(spark, detect.seniority_from_years, years, 0.0, types=["double", "double"]) == level


@pytest.mark.parametrize(
    "said, low, high",
    [
        ("We need 3+ years experience in ML.", 3, None),
        ("Candidates should have 8+ years.", 8, None),
        ("3-5 years of relevant experience required.", 3, 5),
        ("2 to 4 years of professional experience.", 2, 4),
        ("Requires 3–5 years experience building models.", 3, 5),
        ("Bachelor's degree and 5 years of experience.", 5, None),
        ("5 years preferred in a production environment.", 5, None),
        ("Minimum 4 years of software development experience.", 4, None),
        ("At least 3 years experience required.", 3, None),
        ("6+ yrs building deep learning models.", 6, None),
        ("The project took 10 years. Requirements: 3 years of experience with Python.", 3, None),
        ("0-2 years of experience, entry level role.", 0, 2),
    ],
)
def test_experience(spark, said, low, high):
    found = one(spark, experience.experience, said)
    assert (found["min_years"], found["max_years"]) == (low, high)


@pytest.mark.parametrize("said", ["Great team, latest tech stack, amazing office.", "Salary ranges from 30-50 LPA per year.", "", None])
def test_no_experience(spark, said):
    assert one(spark, experience.experience, said) is None


@pytest.mark.parametrize(
    "raw, number", [("10", 10.0), ("4+", 4.0), ("-5", -5.0), ("none", None), (None, None), ("", None)]
)
def test_numbers(spark, raw, number):
    assert one(spark, coerce.to_number, raw) == number


def test_scores_and_lists(spark):
    assert one(spark, coerce.to_score, "150") == 100
    assert one(spark, coerce.to_score, "2.5") == 2
    assert one(spark, coerce.to_unit, "1.7") == 1.0
    assert one(spark, coerce.to_years, "500") is None
    assert one(spark, coerce.to_words, "Python; C++,  ") == ["Python", "C++"]


@pytest.mark.parametrize(
    "answer, found",
    [
        ('```json\n{"a": 1,}\n```', '{"a": 1}'),
        ('<think>{"x": 2}</think> so {"a": "}"} done', '{"a": "}"}'),
        ("no object", None),
        ("{broken", None),
        (None, None),
    ],
)
def test_salvage(spark, answer, found):
    assert one(spark, coerce.salvage_json, answer) == found


def test_excerpt(spark):
    long = "intro " * 100 + "Requirements: " + "word " * 200
    cut = one(spark, lambda c: text.excerpt(c, 200), long)
    assert "Requirements" in cut and len(cut) <= 250
    assert one(spark, lambda c: text.excerpt(c, 200), "short") == "short"
