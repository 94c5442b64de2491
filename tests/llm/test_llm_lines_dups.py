from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vocandra.llm.history import History, repeats_in_arrival_order, signed_batch
from vocandra.llm.lines import frequent_lines, repeated_lines, without_repeated_lines
from vocandra.llm.near_dup import alike_classes, alike_pairs
from vocandra.session import listed

JOBS = "job_id long, title string, company string, description string, source string, first_seen timestamp_ntz, content_hash string, key string, scope string"
WORD = re.compile(r"[^\W_]+")


def made_jobs(n=160, seed=3):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["the", "and", "of"] * 20
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            base = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 4, 12, 20])):
                base[rng.randrange(len(base))] = rng.choice(words)
            if rng.random() < 0.3:
                rng.shuffle(base)
            text = " ".join(base)
        else:
            text = " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\n"]) for _ in range(rng.choice([3, 9, 40, 120])))
        texts.append(text)
        line = "Follow us everywhere, visit %d" % i
        description = rng.choice([text + "\n" + line, text.upper() + "\n" + line]) if i % 17 else rng.choice([None, "", "  \n "])
        rows.append((i, "T", rng.choice(["A", "B ", None]), description, rng.choice(["s1", "s2"]), datetime(2025, 1, 1) + timedelta(days=rng.randrange(9)), None, "k", "x"))
    return rows


def frequent_by_hand(rows):
    key = lambda line: re.sub(r"[\W\d_]+", "", line.lower())
    docs, sizes = defaultdict(set), Counter()
    for r in rows:
        scopes = [("s", r[4])] + ([("c", r[2])] if r[2] and r[2].strip() else [])
        sizes.update(scopes)
        for line in (r[3] or "").split("\n"):
            for scope in scopes:
                if key(line):
                    docs[scope, key(line)].add(r[0])
    out = set()
    for r in rows:
        scopes = [("s", r[4])] + ([("c", r[2])] if r[2] and r[2].strip() else [])
        for no, line in enumerate((r[3] or "").split("\n"), 1):
            if key(line) and any(len(docs[s, key(line)]) >= 8 and len(docs[s, key(line)]) >= 0.05 * sizes[s] for s in scopes):
                out.add((r[0], no))
    return out


def alike_by_hand(rows, share=0.75):
    cut = frequent_by_hand(rows)
    bags = {}
    for r in rows:
        if r[3] and r[3].strip():
            kept = [line for no, line in enumerate(r[3].split("\n"), 1) if (r[0], no) not in cut]
            bags[r[0]] = Counter(WORD.findall("\n".join([r[1], r[2] or "", *kept]).lower()))
    ids = sorted(bags)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 2 * sum((bags[a] & bags[b]).values()) >= share * (sum(bags[a].values()) + sum(bags[b].values()))}


def pairs(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    return made_jobs()


def test_repeated_lines(spark, rows):
    jobs = spark.createDataFrame(rows, JOBS)
    want = frequent_by_hand(rows)
    assert want and pairs(repeated_lines(jobs)) == want
    clean = {r["job_id"]: r["description"] for r in without_repeated_lines(jobs).collect()}
    for r in rows:
        lines = None if r[3] is None else "\n".join(x for no, x in enumerate(r[3].split("\n"), 1) if (r[0], no) not in want)
        assert clean[r[0]] == lines
    assert repeated_lines(jobs.limit(0)).count() == 0


def test_rows_of_one_job_count_once(spark):
    row = (1, "T", "A", "A line that comes again\nx", "s", datetime(2025, 1, 1), None, "k", "x")
    others = [(i, "T", "B", "own line w%s" % ("xyzuvabcd"[i]), "t", datetime(2025, 1, 1), None, "k", "x") for i in range(2, 9)]
    jobs = spark.createDataFrame([row] * 8 + others, JOBS)
    assert repeated_lines(jobs).count() == 0
    many = spark.createDataFrame([(i, *row[1:]) for i in range(8)] + [row] * 3 + others, JOBS)
    assert pairs(repeated_lines(many)) == {(i, n) for i in range(8) for n in (1, 2)}


def test_alike_pairs_match_brute_force(spark, rows):
    jobs = spark.createDataFrame(rows, JOBS)
    want = alike_by_hand(rows)
    got = pairs(alike_pairs(jobs))
    assert got <= want
    # Words replaced at random all over a text are the worst case; near the threshold keys meet with high probability only.
    near = alike_by_hand(rows, 0.85)
    assert len(got & near) >= 0.99 * len(near)
    assert len(got) >= 0.9 * len(want)
    assert alike_pairs(jobs.limit(0)).count() == 0
    classes = alike_classes(jobs).collect()
    assert len({r["job_id"] for r in classes}) == len(classes)


def test_history_decides_by_days(spark, rows):
    jobs = spark.createDataFrame(rows, JOBS)
    links = pairs(alike_pairs(jobs))
    day = {r[0]: r[5].date() for r in rows}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    accepted, want = set(), set()
    for j in sorted(day, key=day.get):
        earlier = {x for x in near[j] if day[x] < day[j] and x in accepted}
        want |= {(min(j, x), max(j, x)) for x in earlier}
        if not earlier:
            accepted.add(j)
    for slice_days in (3, 100):
        assert pairs(repeats_in_arrival_order(jobs, slice_days=slice_days)) == want
    assert repeats_in_arrival_order(jobs.limit(0)).count() == 0


def test_a_third_of_all_rows_copies(spark):
    rows = [(i, "T", "A", "one two three four five six seven eight nine ten", "s", datetime(2025, 1, 1 + i % 3), None, "k", "x") for i in range(30)]
    rows += [(100 + i, "T%d" % i, "A", " ".join("v%d" % (i * 50 + k) for k in range(30)), "s", datetime(2025, 1, 1), None, "k", "x") for i in range(60)]
    jobs = spark.createDataFrame(rows, JOBS)
    # The copies' only line is a repeated line; title and company are left as words.
    classes = {r["job_id"]: r for r in alike_classes(jobs).collect()}
    assert classes[0]["copies"] == 30 and {classes[i]["class_id"] for i in range(30)} == {0}
    assert len(pairs(alike_pairs(jobs))) == 30 * 29 // 2


def signed(spark, rows):
    jobs = spark.createDataFrame(rows, JOBS)
    return signed_batch(jobs, frequent_lines(jobs.limit(0)), set())


def test_history_is_opened_by_a_later_session(spark, tmp_path):
    own = lambda k: " ".join("w%d" % (k * 100 + j) for j in range(40))
    row = lambda i, k, day: (i, "T", "A", own(k), "s", datetime(2025, 1, day), None, "k", "x")
    path = f"file://{tmp_path}/history"
    for day in (1, 2, 3):  # the second merges runs
        history = History(spark.newSession(), path, fan=2, buckets=16)
        assert len(history.runs) == {1: 0, 2: 1, 3: 1}[day]
        batch = signed(spark, [row(10 * day + i, 10 * day + i, day) for i in range(5)] + ([row(10 * day + 9, 10, day)] if day > 1 else []))
        got = pairs(history.absorb(batch))
        assert got == ({(10, 10 * day + 9)} if day > 1 else set())
    history = History(spark, path, fan=2)
    assert len(history.runs) == 2 and history.runs[0]["level"] == 1
    kept = {r["job_id"] for r in history._all("members").collect()}
    assert kept == {10 * day + i for day in range(1, 4) for i in range(5)}
    # A batch of one text opens only the buckets that hold one of its keys.
    few = history._few(signed(spark, [row(90, 10, 9)]).withColumnRenamed("class_id", "id"))
    keys = history._read(history.runs[0], "keys")
    files = lambda frame: len(frame.select(F.input_file_name()).distinct().collect())
    scan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't tell
    chosen = int(re.search(r"SelectedBucketsCount: (\d+) out of 16", scan(keys.filter(F.col("key").isin(few[:5])))).group(1))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert chosen <= 5 and files(keys) > 5
    # Only folders that the manifest names are left, but for the signatures.
    left = {n for n in listed(spark, path) if not n.startswith("manifest")}
    assert {r["name"] for r in history.runs} <= left and len([n for n in listed(spark, path) if n.startswith("manifest")]) == 1
    assert all(set(listed(spark, f"{path}/{n}")) == {"signed"} for n in left - {r["name"] for r in history.runs})
