"""Skills: resolving, scanning texts, matching lists. The taxonomy is a table (name, category, is_alias, canonical_id)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window as W

from vocandra.functions.text import skill_text
from vocandra.session import broadcast_if_small, is_small, stage

try:
    import ahocorasick
except ImportError:  # the join does it as well
    ahocorasick = None

# Worth of the kinds of match, weight of skills that are not required, score without skills.
WORTH = {"exact": 1.0, "related": 0.75, "transferable": 0.5, "missing": 0.0}
PREFERRED_WEIGHT, NO_SKILLS = 0.5, 50.0
SHORTEST = 3
#: Bytes of the file of spellings up to which they are sent to the workers as one automaton; beyond, words meet them in a join.
SENT_BYTES = 8 << 20
#: Groups and keys of a block: every pair of blocks is scored in one go.
GROUPS, KEYS = 256, 512


def aliases(skills: DataFrame) -> DataFrame:
    """(alias, skill, category, rank): one row per normalised spelling; rank puts longer ones first."""
    canonical = skills.filter("is_alias = 0").select(F.col("id").alias("canonical_id"), F.col("name").alias("skill"), F.col("category").alias("of"))
    named = skills.join(canonical, "canonical_id").select(skill_text(F.col("name")).alias("alias"), "skill", F.col("of").alias("category"), "id")
    first = named.filter("alias <> ''").groupBy("alias").agg(F.min_by(F.struct("skill", "category", "id"), "id").alias("r"))
    return first.select("alias", "r.skill", "r.category", F.struct(-F.length("alias"), F.col("r.id")).alias("rank"))


def runs(parts: Column, most: int, glue: str) -> list[Column]:
    """Runs of 1 to ``most`` neighbouring parts, by zipping the array with its own shifts: one pass a length."""
    out = [parts]
    for n in range(2, most + 1):
        length = F.greatest(F.size(parts) - (n - 1), F.lit(0))
        out.append(F.zip_with(F.slice(out[-1], F.lit(1), length), F.slice(parts, F.lit(n), length), lambda a, b: F.concat(a, F.lit(glue), b)))
    return out


def word_runs(c: Column, most: int) -> Column:
    """Runs of 1 to ``most`` words of a normalised text, once each."""
    return F.array_distinct(F.flatten(F.array(*runs(F.split(c, " "), most, " "))))


def spellings_in(texts: DataFrame, names: DataFrame, sent: int = SENT_BYTES, clean_text: Callable[[Column], Column] = skill_text, least: int = SHORTEST) -> DataFrame:
    """(key, alias): the spellings that stand in each text (key, text) as whole words, once each. names: staged (alias, ...),
    normalised as ``clean_text`` does.

    One pass of an Aho-Corasick automaton per text; where the spellings are too many to be sent, the runs of words up
    to the longest spelling's meet them in a hash join.
    """
    clean = texts.select("key", clean_text(F.col("text")).alias("text")).filter("text <> ''")
    listed = names.filter(F.length("alias") >= least).select("alias").distinct()
    if ahocorasick is None or not is_small(names, sent):
        most = listed.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
        return clean.select("key", F.explode(word_runs(F.col("text"), most)).alias("alias")).join(listed, "alias").select("key", "alias")
    words = listed.sparkSession.sparkContext.broadcast([r["alias"] for r in listed.collect()])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for word in words.value:
            automaton.add_word(f" {word} ", word)
        automaton.make_automaton()
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = {word for _, word in automaton.iter(f" {text} ")} if words.value else ()
                keys += [key] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(found, pa.string())], ["key", "alias"])

    return clean.mapInArrow(find, StructType([clean.schema["key"], StructField("alias", StringType())]))


def scan(texts: DataFrame, skills: DataFrame, most: int = 60, sent: int = SENT_BYTES) -> DataFrame:
    """texts: (key, text). (key, skill, category, place): skills named in each text, longer spellings first, ``most`` a text."""
    names = stage(aliases(skills), "spellings")
    hits = spellings_in(texts, names, sent).join(broadcast_if_small(names), "alias").groupBy("key", "skill").agg(F.min("rank").alias("rank"), F.first("category").alias("category"))
    place = F.row_number().over(W.partitionBy("key").orderBy("rank"))
    return hits.withColumn("place", place).filter(F.col("place") <= most).select("key", "skill", "category", "place")


def resolve(names: DataFrame, skills: DataFrame, sent: int = SENT_BYTES) -> DataFrame:
    """names: (name), distinct. (name, skill, category): the exact spelling, else the longest that stands in it, else the name."""
    known = stage(aliases(skills), "spellings")
    table = broadcast_if_small(known)
    exact = names.select("name", skill_text(F.col("name")).alias("alias")).join(table, "alias", "left")
    open_names = exact.filter("skill IS NULL").select(F.col("name").alias("key"), F.col("name").alias("text"))
    inside = spellings_in(open_names, known, sent).join(table, "alias").groupBy(F.col("key").alias("name")).agg(F.min_by(F.struct("skill", "category"), "rank").alias("r"))
    both = exact.join(inside, "name", "left")
    pretty = F.substr(F.trim(F.regexp_replace("name", r"\s+", " ")), F.lit(1), F.lit(80))
    return both.select("name", F.coalesce("skill", "r.skill", pretty).alias("skill"), F.coalesce("category", "r.category").alias("category"))


def match(wanted: DataFrame, offered: DataFrame, related: DataFrame) -> DataFrame:
    """Kinds of match of wanted skills: (group, key, skill, category, required, kind, via).

    wanted: (group, key, skill, category, required); offered: (group, skill, category, place). Three equi-joins on the
    skill, its category and a neighbouring category, each against one row per group and value.
    """
    own = offered.groupBy("group", F.lower("skill").alias("low")).agg(F.min_by("skill", "place").alias("same"))
    in_category = offered.filter("category IS NOT NULL").groupBy("group", "category").agg(F.min_by("skill", "place").alias("near"), F.min("place").alias("at"))
    next_to = in_category.join(related, in_category["category"] == related["b"])
    next_to = next_to.groupBy("group", F.col("a").alias("category")).agg(F.min_by("near", "at").alias("far"))
    rows = wanted.withColumn("low", F.lower("skill")).join(own, ["group", "low"], "left")
    rows = rows.join(in_category.drop("at"), ["group", "category"], "left").join(next_to, ["group", "category"], "left")
    kind = F.when(F.col("same").isNotNull(), "exact").when(F.col("near").isNotNull(), "related").when(F.col("far").isNotNull(), "transferable").otherwise("missing")
    return rows.select("group", "key", "skill", "category", "required", kind.alias("kind"), F.coalesce("same", "near", "far").alias("via"))


def score(matches: DataFrame) -> DataFrame:
    """(group, key, skills, matched, score): worth over weight, 100 at most."""
    worth = F.lit(0.0)
    for kind, x in WORTH.items():
        worth = F.when(F.col("kind") == kind, x).otherwise(worth)
    weight = F.when(F.col("required"), 1.0).otherwise(PREFERRED_WEIGHT)
    out = matches.groupBy("group", "key").agg(F.count("*").alias("skills"), F.count_if(F.col("kind") != "missing").alias("matched"), (F.sum(worth * weight) / F.sum(weight)).alias("share"))
    return out.select("group", "key", "skills", "matched", F.coalesce(100 * F.col("share"), F.lit(NO_SKILLS)).alias("score"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of a column of lists."""
    return np.repeat(np.arange(len(column)), np.asarray(column.value_lengths())), np.asarray(column.flatten())


def _block_scores(groups: pa.StructArray, keys: pa.StructArray) -> list[np.ndarray]:
    """(group, key, skills, matched, score) of each group with each key, as ``score`` of ``match`` gives them.

    groups: own skills, categories and neighbouring categories as hashes; keys: (item, low, category, required) of what each wants.
    """
    owner, item = _lists(keys.field("items"))
    low, category = (_lists(keys.field(c))[1] for c in ("lows", "categories"))
    weight = np.where(_lists(keys.field("required"))[1], 1.0, PREFERRED_WEIGHT)
    item, first, at = np.unique(item, return_index=True, return_inverse=True)
    worth = np.zeros((len(groups), len(item)), np.float32)
    for part, of, kind in (("far", category, "transferable"), ("near", category, "related"), ("own", low, "exact")):
        values, place = np.unique(of[first], return_inverse=True)
        holder, held = _lists(groups.field(part))
        spot = np.searchsorted(values, held)
        there = spot < len(values)
        there[there] = values[spot[there]] == held[there]
        has = np.zeros((len(groups), len(values)), bool)
        has[holder[there], spot[there]] = True
        worth[has[:, place]] = WORTH[kind]
    # What no group has at all counts among the weights only. Worths and weights are halves and quarters: sums are exact.
    useful = worth.any(axis=0)
    column = np.cumsum(useful) - 1
    told = useful[at]
    weights, wanted = (np.zeros((int(useful.sum()), len(keys)), np.float32) for _ in range(2))
    np.add.at(weights, (column[at[told]], owner[told]), weight[told])
    np.add.at(wanted, (column[at[told]], owner[told]), 1)
    worth = worth[:, useful]
    total = np.bincount(owner, weight, minlength=len(keys))
    skills = np.bincount(owner, minlength=len(keys))
    share = (worth @ weights).astype(np.float64) / np.where(total > 0, total, 1.0)
    scored = np.where(total > 0, 100 * share, NO_SKILLS)
    matched = ((worth > 0).astype(np.float32) @ wanted).astype(np.int64)
    names = [np.asarray(x.field("name")) for x in (groups, keys)]
    return [np.repeat(names[0], len(keys)), np.tile(names[1], len(groups)), np.tile(skills, len(groups)), matched.ravel(), scored.ravel()]


def score_pairs(asking: DataFrame, asked: DataFrame, wanted: DataFrame, offered: DataFrame, related: DataFrame, groups: int = GROUPS, keys: int = KEYS) -> DataFrame:
    """``score`` of ``match`` for every group with every key of the same ``on``: (group, key, skills, matched, score).

    asking: (on, group) and asked: (on, key), distinct, their names whole numbers; wanted: (key, skill, category, required); offered: (group,
    skill, category). Groups and keys are packed in blocks, so what is shuffled grows with the pairs of blocks; the
    pairs themselves, as many as the result has rows, are made in place and never shuffled.
    """
    spark = asking.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_category = F.when(F.col("category").isNotNull(), F.xxhash64("category")).otherwise(F.lit(0))
    rows = wanted.withColumn("low", F.lower("skill")).select("key", F.struct(F.xxhash64("low", "category").alias("item"), F.xxhash64("low").alias("low"), of_category.alias("category"), "required").alias("w"))
    rows = asked.join(rows.groupBy("key").agg(F.collect_list("w").alias("w")), "key", "left").withColumn("w", F.coalesce("w", F.array()))
    fields = {"items": "item", "lows": "low", "categories": "category", "required": "required"}
    rows = rows.select("on", F.struct(F.col("key").alias("name"), *[F.col("w")[c].alias(f) for f, c in fields.items()]).alias("k"))

    near = offered.filter("category IS NOT NULL").select("group", "category").distinct()
    far = near.join(related, near["category"] == related["b"]).select("group", F.col("a").alias("category"))
    parts = [offered.select("group", F.lit("own").alias("part"), F.xxhash64(F.lower("skill")).alias("x"))]
    parts += [frame.select("group", F.lit(part).alias("part"), F.xxhash64("category").alias("x")) for part, frame in (("near", near), ("far", far))]
    held = parts[0].union(parts[1]).union(parts[2]).groupBy("group").agg(*[F.collect_set(F.when(F.col("part") == c, F.col("x"))).alias(c) for c in ("own", "near", "far")])
    none = F.array().cast("array<bigint>")
    people = asking.join(held, "group", "left").select("on", F.struct(F.col("group").alias("name"), *[F.coalesce(c, none).alias(c) for c in ("own", "near", "far")]).alias("g"))

    def blocks(frame: DataFrame, most: int, name: str) -> DataFrame:
        return stage(frame.groupBy("on").agg(F.ceil(F.count("*") / most).cast("int").alias(name)), "blocks")

    of_keys, of_groups = broadcast_if_small(blocks(asked, keys, "m")), broadcast_if_small(blocks(asking, groups, "n"))
    packed = rows.join(of_keys, "on").withColumn("i", F.pmod(F.xxhash64("k.name"), "m").cast("int")).repartition(tasks, "on", "i").groupBy("on", "i").agg(F.collect_list("k").alias("keys"))
    people = people.join(of_groups, "on").withColumn("j", F.pmod(F.xxhash64("g.name"), "n").cast("int")).groupBy("on", "j").agg(F.collect_list("g").alias("groups"))
    people = people.join(of_keys, "on").select("on", "groups", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i")).repartition(tasks, "on", "i")
    names = ["group", "key", "skills", "matched", "score"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("groups"), batch.column("keys")):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _block_scores(a.values, b.values)], names)

    return people.join(packed.hint("shuffle_hash"), ["on", "i"]).select("groups", "keys").mapInArrow(find, "group long, key long, skills long, matched long, score double")


def by_kind(matches: DataFrame) -> DataFrame:
    """(group, key, exact, related, transferable, missing): the skills of each kind of match, in alphabetical order."""
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("skill")))).alias(kind)
    return matches.groupBy("group", "key").agg(*[of(kind) for kind in WORTH])


def unmet(matches: DataFrame, level: str = "related") -> DataFrame:
    """(group, key, skill) of skills that must be there and aren't: not the same one, nor, unless ``level`` is exact, a near one."""
    enough = ["exact"] if level == "exact" else ["exact", "related", "transferable"]
    return matches.filter(~F.col("kind").isin(*enough)).select("group", "key", "skill")


def taxonomy_rows(canonical: DataFrame, other: DataFrame) -> DataFrame:
    """canonical: (name, category); other: (alias, name). (name, category, is_alias, place): names by category, then aliases of known names."""
    names = canonical.select("name", "category", F.lit(0).alias("is_alias"))
    met = other.join(canonical.select(F.lower("name").alias("low"), "category").dropDuplicates(["low"]), F.lower(other["name"]) == F.col("low"))
    rows = names.union(met.select("alias", "category", F.lit(1))).dropDuplicates(["name", "is_alias"])
    return rows.select("name", "category", "is_alias")
