"""Variant spellings of names typed by people (problem 1): a trie join.

1. Distinct values are counted, and each is read as a core (the words that name the employer), a line of business and
   a legal form. Values with the same core words, in any order, form a node.
2. Nodes are sharded by routes: each core word, and each pair of outer syllables (first or last three letters of two
   words), so that two names with an edit or a cut in each of two words still share a route. A shard's names go into a
   trie, in each order of their words and with each way of shortening one, and every name of the shard walks the trie
   with its Levenshtein automaton. Shards of more than ``SHARD`` names are split into blocks of names and of queries, each
   pair of which is a unit of work of bounded size.
3. A node's parent is the cheapest heavier neighbour whose line of business doesn't contradict its own: edits plus
   small charges for shortenings and another legal form. Parents lead to one root per employer, so neighbours of
   neighbours aren't merged wholesale.

Defined results: null, empty and blank values are no names; a value without core words (only a legal form, say) is
linked to nothing; values equal but for case or blanks are different values of one employer; ties go to the name with
more rows, then the smaller text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocandra.llm.tries import Trie
from vocandra.session import broadcast_if_small, stage

# Legal forms, lines of business with their usual abbreviations, remarks, endings of pet names.
LEGAL = set("ltd limited llp llc gmbh plc sa pvt private inc incorporated co corp corporation company ag kg bv".split())
BUSINESS = {
    "analytics": "anltcs analyt anl",
    "consulting": "cons consult",
    "engineering": "engg eng engr",
    "group": "grp",
    "holdings": "hldgs hldg holding",
    "international": "intl int",
    "laboratories": "labs lab",
    "logistics": "log logist",
    "manufacturing": "mfg manuf",
    "partners": "ptnrs ptrs",
    "services": "svcs svc service",
    "software": "sw soft",
    "systems": "sys syst",
    "technologies": "tech techn technology",
}
REMARKS = set("the and of careers jobs hq agency branch office".split())
PET_ENDINGS = ("ex", "y", "o", "s")

SHARD = 2000
#: Charges of the ways in which one name may be another's, in edits.
SHORT, ALONE, OTHER_FORM, NO_BUSINESS = 0.5, 1.3, 0.3, 0.1
MOST = 3.4

_BUSINESS_OF = {short: full for full, shorts in BUSINESS.items() for short in [full, *shorts.split()]}
_ASIDE = re.compile(r"\(\s*via\b[^)]*\)?|\[[^\]]*\]?|,\s*careers\b|\s-\s[^-]*\bbranch\b", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours as one edit."""
    older, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        older, row = row, new
    return row[-1]


def plain(text: str) -> str:
    """Without accents; case stays."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@lru_cache(100_000)
def _business(word: str) -> str | None:
    if word in _BUSINESS_OF:
        return _BUSINESS_OF[word]
    if len(word) >= 5:
        for full in BUSINESS:
            if abs(len(full) - len(word)) <= 2 and edits(word, full) <= (2 if len(full) >= 7 else 1):
                return full
    return None


def read_name(value: str) -> tuple[list[str], str, str]:
    """(core words, line of business, legal form) of a typed name."""
    text = re.sub(r"\bs\.\s?a\.?(?!\w)", "sa", _ASIDE.sub(" ", plain(value)), flags=re.IGNORECASE)
    core: list[str] = []
    business, legal = "", []
    for token in re.findall(r"[^\W_]+", text):
        if token.lower() in LEGAL:
            legal.append(token.lower())
            continue
        for word in _CAMEL.sub(" ", token).lower().split():
            kind = _business(word)
            if word in LEGAL:
                legal.append(word)
            elif kind:
                business = business or kind
            elif word not in REMARKS and len(word) > 1:
                core.append(word)
    form = "".join("ltd" if x == "limited" else x for x in legal)
    return list(dict.fromkeys(core)), business, form


def doubled(words: list[str]) -> bool:
    """One word typed twice, once with an edit, in place of two."""
    return len(words) == 2 and min(map(len, words)) >= 5 and edits(*words) <= 2


def routes(words: list[str]) -> set[str]:
    """Shards a name goes to."""
    out = {w for w in words if len(w) >= 5}
    pairs = list(itertools.combinations(words, 2))
    if len(words) == 1:
        w = words[0]
        pairs += [(w[:i], w[i:]) for i in range(4, len(w) - 3)]
        out |= {x for i in range(5, len(w) - 3) for x in (w[:i], w[i:]) if len(x) >= 5}
    for a, b in pairs:
        for x in {a[:3], a[-3:]}:
            for y in {b[:3], b[-3:]}:
                out.add("+".join(sorted((x, y))))
    return out


def _shortened(word: str) -> list[tuple[str, float]]:
    out = [(word, 0.0)]
    if len(word) >= 8:
        out.append((word[:-3], SHORT))
    elif len(word) >= 5:
        out += [(word[:3] + ending, SHORT) for ending in PET_ENDINGS]
    return out


def spellings(words: list[str], business: str, shared: str | None = None) -> dict[str, float]:
    """Ways of writing a name, words joined, with their charges; of its other words only, where ``shared`` is one of them."""
    out: dict[str, float] = {}

    def put(text: str, charge: float) -> None:
        out[text] = min(charge, out.get(text, 9.0))

    rest = [w for w in words if w != shared]
    if len(words) > 3:
        # All orders would be too many: one word may stand anywhere, and one may be shortened.
        for i, word in enumerate(rest):
            others = rest[:i] + rest[i + 1 :]
            for j in range(len(rest)):
                order = [*others[:j], word, *others[j:]]
                for k, w in enumerate(order):
                    for part, charge in _shortened(w):
                        put("".join([*order[:k], part, *order[k + 1 :]]), charge)
        return out
    for order in itertools.permutations(rest):
        for parts in itertools.product(*[_shortened(w) for w in order]):
            put("".join(p for p, _ in parts), sum(c for _, c in parts))
    if shared and len(words) == 2:
        put("", ALONE)
        other = rest[0]
        for letters in (other[0] + business[:1], other[0] + business[:1] + shared[0], shared[0] + other[0] + business[:1]):
            put(letters, SHORT)
    return out


def _rest(words: list[str], shared: str) -> str | None:
    """What is left of a name, joined, without the shard's word; None where the word isn't in it."""
    if shared in words:
        return "".join(w for w in words if w != shared)
    text = words[0] if len(words) == 1 else ""
    return text[len(shared) :] if text.startswith(shared) else text[: -len(shared)] if text.endswith(shared) else None


def _bound(size: int) -> int:
    return 3 if size >= 13 else 2 if size >= 6 else 1 if size >= 4 else 0


def trie_pairs(route: str, names: list[tuple[str, str]], queries: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """Costs of the pairs (name, query) of a shard that are near; both are (core, business), a core's words parted by blanks."""
    shared = None if "+" in route else route
    trie = Trie()
    for core, business in names:
        words = core.split()
        if shared is None or shared in words:
            for text, charge in spellings(words, business, shared).items():
                trie.add(text, (core, charge, len(text), business))
    best: dict[tuple[str, str], float] = {}
    for core, business in queries:
        words = core.split()
        twice = doubled(words)
        text = "".join(words) if shared is None else "" if twice else _rest(words, shared)
        if text is None:
            continue
        for distance, (other, charge, size, line) in trie.near(text, _bound(len(text))):
            if other == core or distance > _bound(size) or (charge and distance > 2) or (twice and charge != ALONE):
                continue
            if charge == ALONE and len(shared or "") < 8 and (not business or business != line):
                continue
            cost = distance * 0.8 + charge if distance > 1 else distance + charge
            if cost <= MOST:
                best[other, core] = min(cost, best.get((other, core), 9.0))
    return best


READ = "company string, n long, core string, business string, form string"
PAIRS = "a string, b string, cost double"


def read_values(values: DataFrame) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [read_name(v) for v in batch["company"]]
            yield pd.DataFrame(
                {
                    "company": batch["company"],
                    "n": batch["n"],
                    "core": [" ".join(sorted(words)) for words, _, _ in rows],
                    "business": [b for _, b, _ in rows],
                    "form": [f for _, _, f in rows],
                }
            )

    return values.mapInPandas(read, READ)


def routed_names(nodes: DataFrame) -> DataFrame:
    """(core, business, route): a row per route of each node."""

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, b, r) for c, b in zip(batch["core"], batch["business"]) for r in sorted(routes(c.split()))]
            yield pd.DataFrame(rows, columns=["core", "business", "route"])

    return nodes.select("core", "business").mapInPandas(route, "core string, business string, route string")


def trie_join(nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """(a, b, cost): pairs of ``nodes`` (core, business) near each other, both ways where both hold.

    Routes are counted with partial sums; the block pairs of a hot route, a first name that a third of all names share,
    are spread over all tasks.
    """
    routed = stage(routed_names(nodes), "routed-names")
    counts = stage(routed.groupBy("route").agg(F.ceil(F.count("*") / shard).cast("int").alias("blocks"), F.count("*").alias("names")).filter("names > 1").drop("names"), "routes")
    routed = routed.join(broadcast_if_small(counts), "route").withColumn("own", F.pmod(F.xxhash64("core"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    queries = routed.select("route", every.alias("block"), F.col("own").alias("part"), "core", "business", F.lit(True).alias("asks"))
    names = routed.select("route", F.col("own").alias("block"), every.alias("part"), "core", "business", F.lit(False).alias("asks"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard_of, held, asked = None, [], []

        def done() -> pd.DataFrame:
            best = trie_pairs(shard_of[0], held, asked)
            return pd.DataFrame([(a, b, c) for (a, b), c in best.items()], columns=["a", "b", "cost"])

        for batch in batches:
            for *at, core, business, asks in zip(*[batch[c] for c in ("route", "block", "part", "core", "business", "asks")]):
                if tuple(at) != shard_of:
                    if held and asked:
                        yield done()
                    shard_of, held, asked = tuple(at), [], []
                (asked if asks else held).append((core, business))
        if held and asked:
            yield done()

    # As many tasks as told, not by size: the work is in the tries.
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = queries.unionByName(names).repartition(tasks, "route", "block", "part").sortWithinPartitions("route", "block", "part")
    found = both.mapInPandas(join, PAIRS)
    return found.groupBy("a", "b").agg(F.min("cost").alias("cost"))


def employers(jobs: DataFrame) -> DataFrame:
    """(company, employer): each non-blank value with the core of the employer it is linked to."""
    values = jobs.filter(F.length(F.trim(F.regexp_replace("company", r"\s+", " "))) > 0).groupBy("company").agg(F.count("*").alias("n"))
    read = stage(read_values(values), "names")
    named = read.filter("core != ''")
    nodes = named.groupBy("core").agg(
        F.sum("n").alias("weight"),
        F.max_by("business", F.when(F.col("business") != "", F.col("n"))).alias("business"),
        F.max_by("form", F.when(F.col("form") != "", F.col("n"))).alias("form"),
    )
    nodes = stage(nodes.na.fill("", ["business", "form"]), "name-nodes")
    near = trie_join(nodes)
    near = near.union(near.select("b", "a", "cost")).groupBy("a", "b").agg(F.min("cost").alias("cost"))

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("core").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("weight", "business", "form")])

    pairs = near.join(side("a"), "a").join(side("b"), "b")
    both = (F.col("business_a") != "") & (F.col("business_b") != "")
    pairs = pairs.filter(~(both & (F.col("business_a") != F.col("business_b"))))
    cost = F.col("cost") + F.when(F.col("form_a") != F.col("form_b"), OTHER_FORM).otherwise(0) + F.when(both, 0).otherwise(NO_BUSINESS)
    heavier = (F.col("weight_b") > F.col("weight_a")) | ((F.col("weight_b") == F.col("weight_a")) & (F.col("b") < F.col("a")))
    pairs = pairs.filter(heavier & (cost <= MOST))
    parent = pairs.groupBy("a").agg(F.min_by("b", F.struct(cost.alias("cost"), -F.col("weight_b"), F.col("b"))).alias("up"))
    up = stage(nodes.select(F.col("core").alias("a")).join(parent, "a", "left").select("a", F.coalesce("up", "a").alias("up")), "name-parents")
    while True:  # each round doubles the height climbed
        higher = up.join(up.select(F.col("a").alias("up"), F.col("up").alias("top")), "up").select("a", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
        higher = stage(higher, "name-parents")
        up = higher.select("a", "up")
        if higher.filter("moved").isEmpty():
            break
    return named.join(up.select(F.col("a").alias("core"), F.col("up").alias("employer")), "core").select("company", "employer")


def variant_pairs(jobs: DataFrame) -> DataFrame:
    """(company_a, company_b): all pairs of different values of one employer, company_a < company_b."""
    linked = employers(jobs)
    left, right = linked.withColumnRenamed("company", "company_a"), linked.withColumnRenamed("company", "company_b")
    return left.join(right, "employer").filter("company_a < company_b").select("company_a", "company_b")
