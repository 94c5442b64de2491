"""Mapping free-entered values to a canonical list (problem 2).

1. Values of each field are made distinct; everything after works on these.
2. A value is normalised to words: accents, case, digits and signs are dropped.
3. Its windows (runs of words, up to some more than the longest entry has) retrieve candidate entries from an inverted index of character trigrams
   of the entries' words, and are scored by cosine, each trigram weighted by its rarity among the entries. Words are
   padded one by one, so the order of words doesn't matter; remarks around the entry fall outside its best window.
4. The best entry is accepted above ``THRESHOLD`` and ``MARGIN`` ahead of any other entry, if an exact check also finds
   every word of the entry in the window: with few edits, shortened, or run together. Codes and entries of up to
   three letters are taken only letter for letter.
5. Values without such an entry are reported with id 0.

Defined results: null and blank values and items are left out; values equal to a canonical name letter for letter
are left out of ``p2_found``, as its definition asks; arrays that are null or no JSON give no items; an entry whose
names are blank is never meant; of two entries with one name, the lower id counts; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocandra.session import broadcast_if_small, stage

#: Words a window may have beyond those of the longest entry, and at least.
BEYOND, LEAST_WINDOW = 2, 6
THRESHOLD = 0.2
MARGIN = 0.03
#: Entries of the reference lists that are sent to the workers at a time; longer lists come in blocks.
LIST_LIMIT = 100_000

# Words between an entry's words that carry no meaning, and words that only say where or how one works.
FILLERS = set("of the and in a an for with".split())
# Usual short forms that aren't a word's start.
SHORT_FORMS = {"mgr": "manager", "mngr": "manager", "sw": "software", "db": "database", "biz": "business", "ops": "operations", "hw": "hardware", "dev": "developer"}


@lru_cache(200_000)
def words_of(text: str) -> tuple[str, ...]:
    folded = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    folded = re.sub(r"\b([sh])/w\b", r"\1w", folded)
    return tuple(SHORT_FORMS.get(w, w) for w in re.findall(r"[^\W\d_]+", folded) if w not in FILLERS)


def _grams(word: str) -> list[str]:
    padded = f"  {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit; ``most`` + 1 if beyond."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        if min(new) > most:
            return most + 1
        older, row = row, new
    return row[-1]


def _allowed(size: int) -> int:
    return 0 if size <= 2 else 1 if size <= 5 else 2 if size <= 8 else 3


@lru_cache(500_000)
def same_word(typed: str, word: str) -> bool:
    """Few edits, or a shortening: its start, or its first letter and more of its letters in order."""
    if typed == word or edits(typed, word, _allowed(min(len(typed), len(word)))) <= _allowed(min(len(typed), len(word))):
        return True
    if len(typed) >= 3 and len(typed) < len(word) and typed[0] == word[0]:
        if word.startswith(typed) or (len(typed) >= 4 and word.startswith(typed[:-1])):
            return True
        letters = iter(word)
        return len(typed) <= 6 and typed[:2] == word[:2] and all(c in letters for c in typed)
    return False


def _covers(window: tuple[str, ...], entry: tuple[str, ...], own: frozenset[str] = frozenset()) -> bool:
    """Whether a window has all words of an entry; ``own`` are the words that no other entry has."""
    left = list(window)
    for word in entry:
        hit = next((w for w in left if w == word), None) or next((w for w in left if same_word(w, word)), None)
        if hit is None:
            break
        left.remove(hit)
    else:
        return True
    if len(window) == len(entry):
        # Another word in one's place is no typo, unless a word of this entry alone stands beside it.
        typed, meant = [w for w in window if w not in entry], [w for w in entry if w not in window]
        told = len(typed) == len(meant) == 1 and any(w in own for w in entry if w in window)
        return told and edits(typed[0], meant[0], 3) <= _allowed(len(meant[0])) + 1
    # Words run together or torn apart.
    a, b = "".join(window), "".join(entry)
    return edits(a, b, 3) <= min(3, max(1, len(b) // 4))


class Canon:
    """Index of a reference list: (id, names) with codes taken only exactly."""

    def __init__(self, entries: list[tuple[int, list[str], list[str]]]) -> None:
        self.exact: dict[tuple[str, ...], int] = {}
        self.codes: dict[str, int] = {}
        self.names: list[tuple[int, tuple[str, ...]]] = []
        self.window = LEAST_WINDOW
        for ref_id, names, codes in sorted(entries):
            for name in names:
                words = words_of(name)
                if words:
                    self.exact.setdefault(words, ref_id)
                    self.exact.setdefault(tuple(sorted(words)), ref_id)
                    self.names.append((ref_id, words))
                    self.window = max(self.window, len(words) + BEYOND)
            for code in codes:
                if code and code.strip():
                    self.codes.setdefault(code.strip().lower(), ref_id)
        holders: dict[str, set[int]] = defaultdict(set)
        for ref_id, words in self.names:
            for word in words:
                holders[word].add(ref_id)
        self.own = frozenset(w for w, ids in holders.items() if len(ids) == 1)
        df: Counter[str] = Counter()
        grams = [Counter(g for w in words for g in _grams(w)) for _, words in self.names]
        for g in grams:
            df.update(g.keys())
        size = max(1, len(self.names))
        self.weight = {g: math.log(1 + size / n) for g, n in df.items()}
        self.unseen = math.log(1 + size)
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, g in enumerate(grams):
            norm = math.sqrt(sum((n * self.weight[x]) ** 2 for x, n in g.items()))
            for x, n in g.items():
                self.postings[x].append((i, n * self.weight[x] / norm))

    def _scores(self, window: tuple[str, ...]) -> dict[int, float]:
        grams = Counter(g for w in window for g in _grams(w))
        total = math.sqrt(sum((n * self.weight.get(g, self.unseen)) ** 2 for g, n in grams.items()))
        out: dict[int, float] = defaultdict(float)
        for g, n in grams.items():
            for i, part in self.postings.get(g, ()):
                out[i] += n * self.weight[g] * part / total
        return out

    def ranked(self, value: str) -> list[tuple[float, int]]:
        """(score, id) of the entry that may be meant and of the next best; codes score 0."""
        words = words_of(value)
        windows = [words[i : i + n] for n in range(min(self.window, len(words)), 0, -1) for i in range(len(words) - n + 1)]
        best: dict[int, float] = {}
        for window in windows:
            hit = self.exact.get(window) or self.exact.get(tuple(sorted(window)))
            if hit and (len("".join(window)) > 3 or len(window) == len(words) or window[0].isascii()):
                best[hit] = max(best.get(hit, 0.0), 1.0 + len("".join(window)) / 100)
        if not best:
            for window in windows:
                if len("".join(window)) <= 3:
                    continue
                for i, score in self._scores(window).items():
                    ref_id, entry = self.names[i]
                    if score >= THRESHOLD and score > best.get(ref_id, 0.0) and len("".join(entry)) > 3 and _covers(window, entry, self.own):
                        best[ref_id] = score
        if not best:
            return [(-i / 1e6, self.codes[w]) for i, w in enumerate(words) if w in self.codes][:1]
        return sorted(((s, r) for r, s in best.items()), key=lambda x: (-x[0], x[1]))[:2]

    def find(self, value: str) -> int:
        """Id of the entry meant, or 0."""
        return decided(self.ranked(value))


def decided(ranked: list[tuple[float, int]]) -> int:
    """The best entry's id, where it is ahead of any other entry; else 0."""
    ranked = sorted(ranked, key=lambda x: (-x[0], x[1]))
    if not ranked or (len(ranked) > 1 and ranked[0][0] > 0 and ranked[0][0] - ranked[1][0] < MARGIN):
        return 0
    return ranked[0][1]


def canonical_ids(values: DataFrame, reference: DataFrame, most: int = LIST_LIMIT) -> DataFrame:
    """values: (field, value). reference: (field, ref_id, names, codes). Returns (field, value, ref_id), distinct, 0 for none.

    Lists of more than ``most`` entries go over the values in blocks by hash of the entry; the best entries of the blocks
    then compete. Rarity is taken within a block, so scores of such lists differ a little from those of one index.
    """
    reference = stage(reference, "reference")
    blocks = max(1, -(-reference.count() // most))
    distinct = stage(values.select("field", "value").filter(F.col("value").rlike(r"\S")).distinct(), "typed-values")
    schema = "field string, value string, ranked array<struct<score:double,ref_id:long>>"
    ranked = []
    for number in range(blocks):
        entries: dict[str, list] = defaultdict(list)
        for r in reference.filter(F.pmod(F.xxhash64("field", "ref_id"), F.lit(blocks)) == number).collect():
            entries[r["field"]].append((r["ref_id"], [x for x in r["names"] or [] if x], [x for x in r["codes"] or [] if x]))
        sent = values.sparkSession.sparkContext.broadcast(dict(entries))

        def find(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            canons = {field: Canon(rows) for field, rows in sent.value.items()}
            none = Canon([])
            for batch in batches:
                rows = [[{"score": s, "ref_id": r} for s, r in canons.get(f, none).ranked(v)] for f, v in zip(batch["field"], batch["value"])]
                yield batch.assign(ranked=rows)

        ranked.append(distinct.mapInPandas(find, schema))
    if blocks == 1:
        together = ranked[0]
    else:
        together = reduce(DataFrame.union, ranked).groupBy("field", "value").agg(F.flatten(F.collect_list("ranked")).alias("ranked"))  # two a block
    best = F.array_sort(F.transform("ranked", lambda x: F.struct((-x["score"]).alias("less"), x["ref_id"].alias("ref_id"))))
    first, second = F.try_element_at("best", F.lit(1)), F.try_element_at("best", F.lit(2))
    # As in ``decided``.
    close = (first["less"] < 0) & second.isNotNull() & (second["less"] - first["less"] < MARGIN)
    return together.withColumn("best", best).select("field", "value", F.when(close, F.lit(0)).otherwise(F.coalesce(first["ref_id"], F.lit(0))).cast("long").alias("ref_id"))


def typed_values(jobs: DataFrame, requirements: DataFrame) -> DataFrame:
    """(job_id, field, item_no, value) of all non-blank typed values."""
    own = [jobs.select("job_id", F.lit(field).alias("field"), F.lit(1).alias("item_no"), F.col(field).alias("value")) for field in ("location", "title")]
    items = F.from_json("required_skills_json", "array<string>")
    skills = requirements.select("job_id", F.lit("skill").alias("field"), F.posexplode(items).alias("at", "value"))
    skills = skills.select("job_id", "field", (F.col("at") + 1).alias("item_no"), "value")
    return own[0].unionByName(own[1]).unionByName(skills).filter(F.col("value").rlike(r"\S"))


def reference_lists(places: DataFrame, titles: DataFrame, skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(field, ref_id, names, codes), and (field, value) of the canonical names."""
    nothing = F.array().cast("array<string>")
    place = places.select(F.lit("location").alias("field"), F.col("place_id").alias("ref_id"), F.concat(F.array("name"), F.coalesce("alt_names", nothing)).alias("names"), F.array("site_code").alias("codes"))
    title = titles.select(F.lit("title").alias("field"), F.col("title_id").alias("ref_id"), F.array("title").alias("names"), nothing.alias("codes"))
    skill = skills.groupBy("canonical_id").agg(F.collect_set("name").alias("names"))
    skill = skill.select(F.lit("skill").alias("field"), F.col("canonical_id").alias("ref_id"), "names", nothing.alias("codes"))
    exact = places.select(F.lit("location").alias("field"), F.col("name").alias("value"))
    exact = exact.unionByName(titles.select(F.lit("title").alias("field"), F.col("title").alias("value")))
    exact = exact.unionByName(skills.filter("is_alias = 0").select(F.lit("skill").alias("field"), F.col("name").alias("value")))
    return place.unionByName(title).unionByName(skill), exact


def mapped_values(jobs: DataFrame, requirements: DataFrame, places: DataFrame, titles: DataFrame, skills: DataFrame) -> DataFrame:
    """(job_id, field, item_no, ref_id) of all values that aren't a canonical name letter for letter."""
    reference, exact = reference_lists(places, titles, skills)
    values = typed_values(jobs, requirements).join(broadcast_if_small(stage(exact, "exact-names")), ["field", "value"], "left_anti")
    found = stage(canonical_ids(values, reference), "canonical")
    return values.join(broadcast_if_small(found), ["field", "value"]).select("job_id", "field", "item_no", "ref_id")
