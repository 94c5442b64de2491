from __future__ import annotations

import random

from vocandra.llm.canonical import Canon, canonical_ids, mapped_values
from vocandra.llm.names import edits, read_name, spellings, trie_join, variant_pairs
from vocandra.llm.tries import Trie


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_trie_finds_all_words_in_reach():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(120)]
    trie = Trie()
    for w in words:
        trie.add(w, w)
    for bound in (0, 1, 2, 3):
        for query in words[:15] + ["", "abcabcabc"]:
            got = sorted({(d, w) for d, w in trie.near(query, bound)})
            assert got == sorted({(levenshtein(query, w), w) for w in words if levenshtein(query, w) <= bound})


def test_edits_count_swaps_once():
    assert edits("smukeg", "sumkeg") == 1 and edits("", "ab") == 2


def test_read_name():
    assert read_name("Doffibges Müssaf Grp LLC (via TalentGrove)") == (["doffibges", "mussaf"], "group", "llc")
    assert read_name("  - ") == ([], "", "")


def test_variants_are_linked_and_others_kept_apart(spark):
    values = ["Natdebpak & Siksot Consulting Inc"] * 5 + [
        "natdebpak siksot consulting inc",
        "Siksot Natdebpak Cons. Inc.",
        "Natdebpk & Sikex Consulting Inc",
        "Natdebpak & Romlul Logistics Ltd",
        "Natdebpak & Romlul Logistics Ltd",
        "Koldin Mipfon Ltd.",
        "Koldintan Mipfon Systems Ltd.",
        "Koldintan Mipfon Systems Ltd.",
        None,
        "",
        "  ",
        "Ltd",
    ]
    jobs = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "job_id long, company string, core string")
    got = {tuple(r) for r in variant_pairs(jobs).collect()}
    one = {"Natdebpak & Siksot Consulting Inc", "natdebpak siksot consulting inc", "Siksot Natdebpak Cons. Inc.", "Natdebpk & Sikex Consulting Inc"}
    want = {(a, b) for a in one for b in one if a < b} | {("Koldin Mipfon Ltd.", "Koldintan Mipfon Systems Ltd.")}
    assert got == want
    assert variant_pairs(jobs.limit(0)).count() == 0


def test_canon_by_cases():
    places = Canon([(1, ["Heskville", "Wyssant"], ["HSL"]), (2, ["Heskwick"], ["HEC"]), (3, ["Thornmoor"], [None])])
    for value, ref_id in [("HESKVILLE", 1), ("Heskvikle 6474", 1), ("near Heskwick", 2), ("HSL office", 1), ("Wysant (Heskville)", 1), ("head office", 0), ("", 0), ("remote", 0), ("Tohrnmoor", 3), ("x" * 5000, 0)]:
        assert places.find(value) == ref_id, value
    titles = Canon([(1, ["Data Engineer"], []), (2, ["Product Manager"], []), (3, ["Clinical Data Manager"], [])])
    for value, ref_id in [("Engineer, Data", 1), ("Sr. Data Engg. [Contract]", 1), ("product mgr III", 2), ("Clinical-Data-Manager", 3), ("locksmith", 0)]:
        assert titles.find(value) == ref_id, value
    assert Canon([]).find("anything") == 0


def test_long_entries_and_other_words():
    long = "Senior Principal Machine Learning Platform Reliability Site Engineer"
    titles = Canon([(1, [long], []), (2, ["Data Engineer"], [])])
    for value, ref_id in [(long, 1), (long.replace("Platform", "Platfrom"), 1), ("Site Engineer", 0), ("Gate Engineer", 0), ("Dataengineer", 2), ("Dta Engineer", 2)]:
        assert titles.find(value) == ref_id, value


def test_lists_in_blocks_find_the_same(spark):
    names = ["Heskville", "Wyssant Harbour", "Thornmoor", "Data Engineer", "Product Manager", "Clinical Data Manager", "Rilke Sound"]
    reference = spark.createDataFrame([("x", i, [n], []) for i, n in enumerate(names, 1)], "field string, ref_id long, names array<string>, codes array<string>")
    typed = ["HESKVILLE", "wysant harbour", "Thornmor (remote)", "engineer, data", "prodct manager", "nothing", "Sound Rilke", "Clinical data manager II"]
    values = spark.createDataFrame([("x", v) for v in typed], "field string, value string")
    whole, blocks = ({tuple(r) for r in canonical_ids(values, reference, most).collect()} for most in (100, 2))
    assert whole == blocks and ("x", "nothing", 0) in whole and ("x", "Sound Rilke", 7) in whole


def test_mapped_values(spark):
    jobs = spark.createDataFrame([(1, "Heskville", "Data Enginer"), (2, None, "locksmith"), (3, " ", "Data Engineer")], "job_id long, location string, title string")
    needs = spark.createDataFrame([(1, '["python3", "", "Python"]'), (2, None), (3, "no json")], "job_id long, required_skills_json string")
    places = spark.createDataFrame([(5, "Heskville", [], "HSL")], "place_id long, name string, alt_names array<string>, site_code string")
    titles = spark.createDataFrame([(7, "Data Engineer")], "title_id long, title string")
    listed = spark.createDataFrame([(1, "Python", "C", 0, 1), (2, "python3", "C", 1, 1)], "id long, name string, category string, is_alias int, canonical_id long")
    got = {tuple(r) for r in mapped_values(jobs, needs, places, titles, listed).collect()}
    assert got == {(1, "title", 1, 7), (2, "title", 1, 0), (1, "skill", 1, 1)}
    assert mapped_values(jobs.limit(0), needs.limit(0), places, titles, listed).count() == 0


def test_hot_routes_in_blocks_find_the_same(spark):
    rng = random.Random(7)
    made = lambda: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(4))
    names = sorted({f"{made()} globalia" for _ in range(60)})
    typed = [n[:3] + n[4:] for n in names[:20]]
    nodes = spark.createDataFrame([(" ".join(sorted(n.split())), "") for n in names + typed], "core string, business string").distinct()
    whole, blocks = ({(r["a"], r["b"], round(r["cost"], 6)) for r in trie_join(nodes, shard).collect()} for shard in (2000, 7))
    assert whole == blocks and len(whole) >= 20


def test_long_names_have_orders_and_shortenings():
    words = ["brandel", "costigan", "drummond", "eastlake"]
    found = spellings(words, "")
    for text in ("eastlakebrandelcostigandrummond", "brandelcostigandrummondeastl", "costiganbrandeldrummondeastlake"):
        assert text in found, text
