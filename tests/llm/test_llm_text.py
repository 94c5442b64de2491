from __future__ import annotations

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocandra.llm import abuse, bpe, packing, pii, tagger

HAS_VOCABULARY = os.path.exists(bpe.vocabulary_path())


@pytest.mark.skipif(not HAS_VOCABULARY, reason="no vocabulary file")
def test_token_ids_equal_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks(bpe.vocabulary_path())
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["", " ", "  a\n\n b", "don't", "<|endoftext|>", "日本語 हिन्दी 👩🏽‍💻", "x" * 3000]
    texts += ["".join(rng.choice("abcdeinrst  '1.\n") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    encoder = bpe.Encoder(ranks)
    for t in texts:
        assert encoder.encode(t) == library.encode_ordinary(t), t
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "hello")], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.token_ids(docs).collect()}
    assert got == {1: [], 2: [], 3: library.encode_ordinary("hello")}


def test_plan_uses_everything_once():
    rng = random.Random(5)
    for _ in range(20):
        counts = {rng.randint(1, 100): rng.randint(1, 40) for _ in range(rng.randint(0, 30))}
        plan = packing.plan_fillings(counts, 100, (100, 50, 25))
        used: dict[int, int] = {}
        for sizes, times in plan:
            assert sum(sizes) <= 100 and times > 0
            for s in sizes:
                used[s] = used.get(s, 0) + times
        assert used == counts


def test_tiers_have_windows_of_their_own():
    rng = random.Random(8)
    counts = Counter(rng.choice([rng.randint(1, 60), rng.randint(1, 300), rng.randint(300, 1000)]) for _ in range(5000))
    plans = {tiers: packing.plan_windows(counts, 1000, tiers) for tiers in ((1000,), (1000, 500, 250))}
    tiered = plans[1000, 500, 250]
    assert {tier for _, _, tier in tiered} == {1000, 500, 250} and tiered != plans[(1000,)]
    for windows, times, tier in tiered:
        assert len(windows) <= 1000 // tier and all(sum(w) <= tier for w in windows)
        # A window of a tier is opened by a size that no shorter tier has room for; rests of tiers share a container.
        assert all(tier == 250 or max(w) > tier // 2 for w in windows) or times == 1
    containers = {k: sum(times for _, times, _ in plan) for k, plan in plans.items()}
    assert containers[1000, 500, 250] <= containers[(1000,)]
    # Where nothing small closes short windows, they aren't used.
    assert {tier for _, _, tier in packing.plan_windows({200: 1000}, 1000, (1000, 500, 250))} == {1000}


def test_step_groups_are_balanced(spark):
    rng = random.Random(9)
    sizes = [rng.choice([30, 70, 90]) for _ in range(9000)] + [3] * 5
    items = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens int")
    rows = packing.pack(items, 100, (100, 50)).groupBy("step_group").agg(F.sum("tokens"), F.count_distinct("container_id")).collect()
    assert len(rows) > 10
    assert max(r[1] for r in rows) - min(r[1] for r in rows) < 200 and max(r[2] for r in rows) - min(r[2] for r in rows) <= 1


def test_pack(spark):
    rng = random.Random(6)
    sizes = [rng.choice([0, 5, 40, 60, 99, 100, 101, 350]) for _ in range(300)]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)] + [(900, None), (901, -3)], "doc_id long, tokens int")
    rows = packing.pack(items, 100, (100, 50, 25)).collect()
    held: dict[int, list] = {}
    for r in rows:
        held.setdefault(r["container_id"], []).append((r["at"], r["tokens"]))
    for places in held.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 100
    total: dict[int, int] = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["tokens"]
    assert total == {i: s for i, s in enumerate(sizes) if s}
    parts = {i: sum(r["doc_id"] == i for r in rows) for i in total}
    assert all(parts[i] == 1 for i in total if sizes[i] <= 100)
    assert len(held) <= 1.08 * -(-sum(sizes) // 100)
    assert packing.pack(items.limit(0), 100, (100, 50, 25)).count() == 0


def test_tagger_gradients():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in tagger.init(4, 5).items()}
    x, gold = rng.integers(0, tagger.CODES, (6, 3)), rng.integers(0, tagger.LABELS, (6, 3))
    _, grad = tagger.gradients(w, x, gold)
    for k in w:
        at = tuple(rng.integers(0, n) for n in w[k].shape) if k != "embed" else (int(x[2, 1]), 0)
        old = w[k][at]
        losses = []
        for step in (1e-4, -1e-4):
            w[k][at] = old + step
            losses.append(tagger.gradients(w, x, gold)[0])
        w[k][at] = old
        assert abs((losses[0] - losses[1]) / 2e-4 - grad[k][at]) < 2e-2 * max(1, abs(grad[k][at])), k


def test_spans():
    assert tagger.spans(np.array([0, 1, 2, 1, 0, 4, 4])) == [(1, 3, "email"), (3, 4, "email"), (5, 7, "phone")]


@pytest.mark.skipif(not os.path.exists(pii.WEIGHTS), reason="no weights")
def test_found_and_redacted(spark):
    text = "Former post holder Ulrika Vandmire (ID X0057518) will hand over in person.\nTel (988) 555-0145 / e-mail prydwell_piet@xylysk.example - no visits please."
    finder = pii.Finder(pii.load_weights())
    items = finder.find([text])[0]
    assert {(k, pii.value_of(text[a:b])) for a, b, k in items} == {("name", "ulrikavandmire"), ("identity", "x0057518"), ("phone", "9885550145"), ("email", "prydwellpietxylyskexample")}
    assert pii.redact(text, items).startswith("Former post holder <NAME> (ID <IDENTITY>)")
    long = "plain words " * 3000 + text
    assert len(finder.find([long, "", "no items here"])[0]) == 4
    jobs = spark.createDataFrame([(1, text), (2, None), (3, "")], "job_id long, description string")
    people = spark.createDataFrame([(1, '{"summary": "Second contact is Lunetta Prydwell (lunetta@b.example)."}'), (2, None), (3, "[")], "id long, profile_json string")
    got = {tuple(r) for r in pii.found(jobs, people).collect()}
    assert ("candidate_profile", 1, "email", "lunettabexample") in got and ("jobs", 1, "identity", "x0057518") in got
    assert [r["description"] for r in pii.redacted(jobs).orderBy("job_id").collect()][1:] == [None, ""]
    assert pii.found(jobs.limit(0), people.limit(0)).count() == 0


def abuse_texts(n, seed):
    rng = random.Random(seed)
    fill = ["The office in Ostona is quiet.", "Pay was fair for all of us.", "We reviewed the release notes.", "They asked about queries and storage.", "I like to plan the budget."]
    bad = ["You are a worthless %s and all know it.", "Shut up, you filthy %s!!", "hey %s, quit, nobody wants you"]
    near = ["We remove posts that call people %s, see the policy.", "A %s farm wants testing skills."]
    who = ["moron", "scum", "clown", "maggot", "1d10t", "l o s e r"]
    out = []
    for i in range(n):
        lines = [rng.choice(fill) for _ in range(rng.randint(1, 8))]
        label = i % 4 == 0
        if label or i % 4 == 1:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(bad if label else near) % rng.choice(who))
        out.append(("\n".join(lines), label))
    return out


def test_abuse_held_out():
    train, held = abuse_texts(600, 1), abuse_texts(200, 2)
    model = abuse.fit([t for t, _ in train], np.array([y for _, y in train], float))
    case = model.score([t for t, _ in held]) >= abuse.CASE
    truth = np.array([y for _, y in held])
    assert (case == truth).mean() > 0.95
    assert model.score([None, "", "  \n"]).tolist() == [0.0, 0.0, 0.0]


def test_isotonic_is_monotone():
    ends, values = abuse.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([0.0, 0.0, 1.0, 1.0]))
    assert (np.diff(values) > 0).all() and ends[-1] == 4.0


def test_abuse_queries_on_small_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "You are a worthless filthy moron", "b"), (4, "Fine day", "b")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, label string")
    assert [r["doc_id"] for r in abuse.cases(docs, none).collect()] == [3]
    rates = {r["source"]: (r["documents"], r["cases"]) for r in abuse.source_rates(docs, none).collect()}
    assert rates == {"a": (2, 0), "b": (2, 1)}
