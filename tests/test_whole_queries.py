from __future__ import annotations

import re

import pytest

from vocandra.functions import text
from vocandra.operators import skills
from vocandra.plans.core_queries import QUERIES
from vocandra.session import table

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["skill_scores_all"])
def test_skill_scores_of_all_postings(spark, name):
    got = {(r["candidate_id"], r["job_id"]): (r["skills"], r["matched"], r["score"]) for r in QUERIES[name](spark, DATA).collect()}
    people = {r["id"] for r in table(spark, DATA, "candidate_profile").filter("id % 100 = 0").collect()}
    jobs = {r["job_id"] for r in table(spark, DATA, "job_requirements").collect()}
    assert people and set(got) == {(p, j) for p in people for j in jobs}
    # The scores by target role are a part of it.
    part = {(r["candidate_id"], r["job_id"]): (r["skills"], r["matched"], r["score"]) for r in QUERIES["skill_scores"](spark, DATA).filter("candidate_id % 100 = 0").collect()}
    assert part and all(got[k] == pytest.approx(v) for k, v in part.items())


def test_section_excerpts(spark):
    got = {r["doc_id"]: r["excerpt"] for r in QUERIES["section_excerpts"](spark, DATA).collect()}
    marker = re.compile(text.SECTION)
    kinds = set()
    for r in table(spark, DATA, "documents").filter("text IS NOT NULL").collect():
        whole, m = r["text"], marker.search(r["text"])
        if len(whole) <= 600:
            kind, want = "short", whole
        elif m and m.start() < len(whole) - 100:
            kind, want = "section", (whole[max(0, m.start() - 150) : m.start()] + "\n" + whole[m.start() : m.start() + 600])[:750]
        else:
            kind, want = "head", whole[:600]
        kinds.add(kind)
        assert got[r["doc_id"]] == want
    assert {"short", "head"} <= kinds


def test_the_whole_report(spark):
    rows = QUERIES["matched_report_all"](spark, "/root/testdata/sf0.1").collect()
    assert len(rows) > 1000
    rows.sort(key=lambda r: (r["verdict"] != "MATCH", -r["final_score"], r["job_id"]))
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1))
    first = {tuple(r) for r in QUERIES["matched_report"](spark, "/root/testdata/sf0.1").collect()}
    assert {tuple(r) for r in rows[:1000]} == first


@pytest.mark.parametrize("name", ["skill_scores", "skill_scores_all"])
def test_pairs_of_skill_scores_are_not_shuffled(spark, name):
    """Pairs are made once and grow with both tables: nothing is exchanged behind them."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0] and "MapInArrow" in plan


def test_score_pairs_by_blocks(spark):
    wanted = [(k, f"s{(k * j) % 9}", "ABCD"[(k * j) % 9 % 4] if (k * j) % 9 < 7 else None, j % 2 == 0) for k in range(1, 30) for j in range(k % 5)]
    wanted = spark.createDataFrame(sorted({(k, s): (k, s, c, r) for k, s, c, r in wanted}.values(), key=str), "key long, skill string, category string, required boolean")
    offered = spark.createDataFrame([(g, f"S{s}", "ABCD"[s % 4], p) for g in range(11) for p, s in enumerate(range(g % 4)) if s % (g + 1) != 2], "group long, skill string, category string, place int")
    related = spark.createDataFrame([("A", "B"), ("B", "A")], "a string, b string")
    asking = spark.createDataFrame([(g % 2, g) for g in range(11)], "on int, group long")
    asked = spark.createDataFrame([(k % 3, k) for k in range(1, 30)], "on int, key long")
    got = skills.score_pairs(asking, asked, wanted, offered, related, groups=2, keys=3)
    rows = {(r["group"], r["key"]): tuple(r)[2:] for r in got.collect()}
    met = asking.join(asked, "on").select("group", "key")
    whole = skills.score(skills.match(met.join(wanted, "key"), offered, related))
    want = {(r["group"], r["key"]): (0, 0, skills.NO_SKILLS) for r in met.collect()} | {(r["group"], r["key"]): tuple(r)[2:] for r in whole.collect()}
    assert got.count() == len(rows) and rows == want
