from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from vocandra.llm.near_dup import alike_classes, candidate_pairs

KEYED = "id long, keys array<long>, n int, bits0 long, bits1 long, bits2 long, bits3 long, new boolean"


def rows(n):
    """One key that all share and one of each row's own; odd rows are far from even ones by their sketches."""
    far = -(2**63)
    return [(i, [1, 1000 + i], 20, far + 7 if i % 2 else 0, -1 if i % 2 else 0, 0, 0, i >= n - 5) for i in range(n)]


def test_one_shared_hot_key_is_enough(spark):
    n = 1100
    keyed = spark.createDataFrame(rows(n), KEYED)
    for block in (100, 4096):
        got = candidate_pairs(keyed.select("id", "keys"), keyed, block=block)
        assert got.count() == 2 * (550 * 549 // 2)
        assert got.filter("a >= b OR (a - b) % 2 <> 0").isEmpty()


def test_hot_keys_with_new_ids(spark):
    n = 1100
    keyed = spark.createDataFrame(rows(n), KEYED)
    want = {(a, b) for b in range(n - 5, n) for a in range(b) if (a - b) % 2 == 0}
    for block in (3, 4096):
        got = candidate_pairs(keyed.select("id", "keys", "new"), keyed, by_new=True, block=block)
        assert {tuple(r) for r in got.collect()} == want


def test_a_cluster_of_over_a_thousand_variants(spark):
    # All share one sentence; each has eight words of its own, all over the segments.
    shared = " ".join(f"s{j}" for j in range(30))
    jobs = []
    for i in range(1100):
        own = "".join(chr(97 + int(c)) for c in str(i))
        jobs.append((i, "T", "C%d" % (i % 300), f"{shared}. " + " ".join(f"{own}{x}" for x in "klmnopqr"), "s%d" % (i % 40), datetime(2025, 1, 1)))
    frame = spark.createDataFrame(jobs, "job_id long, title string, company string, description string, source string, first_seen timestamp_ntz")
    got = alike_classes(frame).agg(F.min("links"), F.count("*")).first()
    assert tuple(got) == (1099, 1100)
