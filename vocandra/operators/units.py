"""Quantities recorded in different units (problem 4): a graph of notations.

A pay text is read as amounts, a currency and a notation: what is left of the text but fillers, like ``k pa`` or ``wk``. Each
notation is a source in a graph:

1. the same posting under other urls links records of two notations: same currency, and a long line. The fewer postings have
   the line, the more it tells about who posted: lines of up to ``FEW`` postings, of twice as many, and so on are levels of
   evidence of their own, and commoner lines count where rarer ones teach nothing; none is left out;
2. each pair of notations gets, by level, a robust scale, the median ratio over linked postings, and an offset, the median
   difference left at that scale; known conversions have no offset, so a pair with one is no evidence;
3. notations spelt in the words of ``pay_units`` are anchors; from them factors spread in rounds along the best supported
   links, each product snapped to the nearest known conversion (a period times a scale) or left to the next best link;
4. what no link reaches is read by its usual short forms and reported as not learned; what stays unknown is no statement of pay.

Where the pay text has no period or currency, the description's pay sentence gives them.

Defined results: null, empty and amountless texts, percentages and zero amounts are no case; a single amount is both
ends; ends in the wrong order are put right; texts with both a decimal and a grouped reading are grouped, unless a
scale word follows; empty tables give no rows; other columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocandra.session import broadcast_if_small, stage

#: Links below which a pair of notations says nothing, and how far from a known conversion its scale may be.
LINKS = 3
TOLERANCE = 0.04
#: Characters of a long line, and postings with pay up to which long lines are all alike rare.
LONG_LINE, FEW = 60, 12

# Usual short forms of the units in pay_units.
PERIOD_FORMS = {
    "hour": "hour hourly hr hrs h ph",
    "day": "day daily diem pd",
    "week": "week weekly wk pw",
    "fortnight": "fortnight fortnightly biweekly",
    "month": "month monthly mo mth pm pcm",
    "quarter": "quarter quarterly qtr",
    "year": "year yearly yr annum annual annually pa",
}
SCALE_FORMS = {"thousand": "thousand thousands k", "lakh": "lakh lakhs lac lacs l", "million": "million millions mn m", "crore": "crore crores cr"}
CURRENCIES = {"USD": r"usd|us\$|us dollars?|dollars?|\$", "EUR": "eur|euros?|€", "GBP": "gbp|pounds?(?: sterling)?|sterling|£", "INR": r"inr|(?:indian )?rupees?|rs\.?|₹"}
CURRENCY = r"(?<![a-z])(?:" + "|".join(CURRENCIES.values()) + r")(?![a-z])"
FILLER = set("pay salary from to up between and bonus a an per each every the of about circa gross".split())

NUMBER = r"(\d{1,3}(?: \d{3})+(?![\d])|\d[\d.,]*\d|\d)(?![\d.,]*\s*%)"
PERIOD_WORDS = r"(?<![a-z])(hour|day|week|fortnight|month|quarter|year)(?:ly|s)?(?![a-z])|(?<![a-z])(annum|annual|annually|daily)(?![a-z])"
PAY_SENTENCE = r"(?i)\b(pay|paid|salar(?:y|ies)|remuneration|wages?|compensation|before tax|currency)\b"


def _lookup(forms: dict[str, str]) -> dict[str, str]:
    return {short: unit for unit, shorts in forms.items() for short in shorts.split()}


_PERIODS, _SCALES = _lookup(PERIOD_FORMS), _lookup(SCALE_FORMS)


def currency_of(text: Column) -> Column:
    """The first currency named."""
    named = F.regexp_extract(text, CURRENCY, 0)
    out = F.lit(None).cast("string")
    for code, pattern in reversed(CURRENCIES.items()):
        out = F.when(named.rlike(f"^(?:{pattern})$"), F.lit(code)).otherwise(out)
    return out


def amount_of(number: Column, scaled: Column) -> Column:
    """A typed number as decimal(20,4)."""
    spaceless = F.regexp_replace(number, " ", "")
    grouped = spaceless.rlike(r"^\d{1,3}(?:[.,]\d{3})+$|^\d{1,2}(?:,\d{2})*,\d{3}$") & ~(scaled & spaceless.rlike(r"^\d+\.\d+$"))
    grouped = grouped & ~spaceless.rlike(r"^0[.,]")
    plain = F.when(grouped, F.regexp_replace(spaceless, "[.,]", "")).when(
        spaceless.rlike(r"^\d+,\d{1,2}$"), F.regexp_replace(spaceless, ",", ".")
    ).otherwise(F.regexp_replace(spaceless, ",", ""))
    return plain.try_cast("decimal(20,4)")


def read_pay(jobs: DataFrame) -> DataFrame:
    """(job_id, low, high, currency, notation, lines) and the description's (said_currency, said_period, said_scale); lines: hashes of the long lines."""
    text = F.lower(F.regexp_replace("salary", r"[   ]", " "))
    numbers = F.regexp_extract_all("pay", F.lit(NUMBER), F.lit(1))
    left = F.regexp_replace(F.regexp_replace("pay", NUMBER, " # "), CURRENCY, " ")
    left = F.regexp_replace(F.regexp_replace(left, r"(?<=[a-z])[./](?=[a-z])", ""), r"[^a-z%]+", " ")
    left = F.regexp_replace(F.concat(F.lit(" "), left, F.lit(" ")), rf" (?:(?:{'|'.join(FILLER)}) )+", " ")
    left = F.regexp_replace(left, r" ([a-z]+)(?: \1)+(?= )", " $1")
    read = jobs.select("job_id", "description", text.alias("pay")).filter(F.col("pay").rlike(r"\d"))
    read = read.withColumn("numbers", numbers).filter(F.size("numbers") > 0)
    scaled = F.col("pay").rlike(r"\d\s*(?:k|l|lpa|m|mn|cr|thousand|lakhs?|million|crores?)\b")
    ends = [amount_of(F.try_element_at("numbers", F.lit(i)), scaled) for i in (1, 2)]
    sentences = F.split("description", r"\n|(?<=[.!?])\s+(?=[A-Z(])")
    said = F.filter(sentences, lambda s: s.rlike(PAY_SENTENCE) & F.lower(s).rlike(CURRENCY) & F.lower(s).rlike(PERIOD_WORDS))
    long_lines = F.filter(F.split(F.lower("description"), "\n"), lambda s: F.length(s) >= LONG_LINE)
    lines = F.array_distinct(F.transform(long_lines, lambda s: F.xxhash64(F.regexp_replace(s, r"[^\p{L}\p{N}]+", ""))))
    read = read.select(
        "job_id",
        ends[0].alias("first"),
        F.coalesce(ends[1], ends[0]).alias("second"),
        currency_of(F.col("pay")).alias("currency"),
        F.trim(left).alias("notation"),
        lines.alias("lines"),
        F.lower(F.try_element_at(said, F.lit(1))).alias("said"),
    )
    # The period named nearest to the currency: in the same clause, before or after.
    before = F.regexp_extract("said", rf"({PERIOD_WORDS})[^.(]{{0,14}}{CURRENCY}", 1)
    after = F.regexp_extract("said", rf"{CURRENCY}[^.]{{0,40}}?({PERIOD_WORDS})", 1)
    unit = F.regexp_replace(F.when(before != "", before).otherwise(after), r"(?<=hour|week|fortnight|month|quarter|year)(?:ly|s)$", "")
    unit = F.when(unit.rlike("^ann"), "year").when(unit == "daily", "day").otherwise(unit)
    scale = F.regexp_extract("said", r"(?<![a-z])(thousand|lakh|million|crore)s?(?![a-z])", 1)
    return read.select(
        "job_id",
        F.least("first", "second").alias("low"),
        F.greatest("first", "second").alias("high"),
        "currency",
        "notation",
        "lines",
        currency_of(F.col("said")).alias("said_currency"),
        F.when(unit != "", unit).alias("said_period"),
        F.when(scale != "", scale).alias("said_scale"),
    ).filter("high > 0")


def words_of(notation: str) -> tuple[list[str], list[str], list[str]]:
    """(period words, scale words, other words) of a notation."""
    text = re.sub(r"\b(?:every )?two weeks\b", "fortnight", notation)
    text = re.sub(r"\blpa\b", "lakh annum", text)
    periods, scales, others = [], [], []
    for word in text.split():
        if word in _PERIODS:
            periods.append(_PERIODS[word])
        elif word in _SCALES:
            scales.append(_SCALES[word])
        elif word not in FILLER:
            others.append(word)
    return periods, scales, others


def spelt_out(notation: str, factors: dict[str, int]) -> int | None:
    """The factor of a notation that uses no unit words but those of ``pay_units`` (with -ly or -s), else None."""
    product, periods = 1, 0
    for word in set(notation.split()):
        unit = next((u for u in factors if word in (u, f"{u}ly", f"{u}s")), None)
        if unit is not None:
            product *= factors[unit]
            periods += unit in PERIOD_FORMS
        elif word not in FILLER:
            return None
    return product if periods == 1 else None


def by_short_forms(notation: str, factors: dict[str, int]) -> int | None:
    periods, scales, _ = words_of(notation)
    if len(set(periods)) != 1 or len(set(scales)) > 1:
        return None
    return factors[periods[0]] * (factors[scales[0]] if scales else 1)


def spread(pairs: DataFrame, anchors: DataFrame, conversions: list[int]) -> DataFrame:
    """(notation, factor) reached from the anchors (notation, factor); pairs: (a, b, level, links, ratio), ratio the log of b's amounts over a's.

    In each round every notation next to known ones takes the factor of its best supported link, by rarer lines first, that
    snaps to a conversion. Rounds are as many as the graph is deep.
    """
    edges = stage(pairs.select("a", "b", "level", "links", "ratio").union(pairs.select("b", "a", "level", "links", -F.col("ratio"))), "notation-edges")
    known = stage(anchors.select("notation", F.col("factor").cast("long").alias("factor")), "notation-factors")
    options = F.array(*[F.lit(int(c)) for c in conversions])
    while True:
        level = F.ln("factor") - F.col("ratio")
        nearest = F.array_min(F.transform(options, lambda f: F.struct(F.abs(F.ln(f) - level).alias("off"), f.cast("long").alias("factor"))))
        met = edges.join(known.withColumnRenamed("notation", "a"), "a").join(known.select(F.col("notation").alias("b")), "b", "left_anti")
        met = met.withColumn("n", nearest).filter(F.col("n.off") <= TOLERANCE)
        fresh = met.groupBy(F.col("b").alias("notation")).agg(F.max_by("n.factor", F.struct(-F.col("level"), "links", -F.col("n.off"), "a")).alias("factor"))
        fresh = stage(fresh, "notation-factors")
        if fresh.isEmpty():
            return known
        known = stage(known.unionByName(fresh), "notation-factors")


def notation_pairs(pay: DataFrame) -> DataFrame:
    """(a, b, level, links, ratio, shift): robust scale (its log) and offset between notations over linked postings; staged.

    level: 0 of lines that up to ``FEW`` postings have, then one more for each doubling. Levels whose links agree.
    """
    rows = pay.filter("currency IS NOT NULL AND low > 0").select("job_id", "currency", "notation", F.col("low").cast("double").alias("amount"), F.explode("lines").alias("line"))
    # One row per line and notation: a line makes pairs of notations, not of postings, however many have it.
    one = rows.groupBy("line", "currency", "notation").agg(F.percentile_approx("amount", 0.5).alias("amount"), F.count("*").alias("postings"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.sum("postings") / FEW))).cast("int")
    levels = one.groupBy("line").agg(level.alias("level"), F.count("*").alias("kinds")).filter("kinds > 1").select("line", "level")
    one = one.join(levels, "line")
    left = one.select("line", "level", "currency", F.col("notation").alias("a"), F.col("amount").alias("x"))
    right = one.select("line", "currency", F.col("notation").alias("b"), F.col("amount").alias("y"))
    # The lines two postings share say one thing: equal amounts count once.
    both = stage(left.join(right, ["line", "currency"]).filter("a < b").groupBy("a", "b", "currency", "x", "y").agg(F.min("level").alias("level")), "notation-links")
    ratio = F.ln(F.col("y") / F.col("x"))
    scaled = both.groupBy("a", "b", "level").agg(
        F.count("*").alias("links"),
        F.percentile_approx(ratio, 0.5, F.lit(1000)).alias("ratio"),
        F.percentile_approx(ratio, 0.25, F.lit(1000)).alias("q1"),
        F.percentile_approx(ratio, 0.75, F.lit(1000)).alias("q3"),
    )
    scaled = scaled.filter((F.col("links") >= LINKS) & (F.col("q3") - F.col("q1") <= 2 * TOLERANCE)).select("a", "b", "level", "links", "ratio")
    shifts = both.join(broadcast_if_small(stage(scaled, "notation-scales")), ["a", "b", "level"])
    shift = F.percentile_approx(F.col("y") - F.exp("ratio") * F.col("x"), 0.5)
    return stage(shifts.groupBy("a", "b", "level").agg(F.first("links").alias("links"), F.first("ratio").alias("ratio"), shift.alias("shift")), "notation-pairs")


def notation_factors(pay: DataFrame, units: DataFrame) -> DataFrame:
    """(notation, factor, learned, rows): currency units a year of one unit of each notation that has a known one."""
    rows = units.collect()
    factors = {r["unit"]: int(r["factor"]) for r in rows}
    periods = [int(r["factor"]) for r in rows if r["kind"] == "period"]
    conversions = sorted({p * s for p in periods for s in [1] + [int(r["factor"]) for r in rows if r["kind"] == "scale"]})
    notations = stage(pay.groupBy("notation").agg(F.count("*").alias("rows")), "notation-counts")

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(factor=pd.array([spelt_out(n, factors) for n in batch["notation"]], dtype="Int64"))

    anchors = notations.select("notation").mapInPandas(spell, "notation string, factor long").filter("factor IS NOT NULL")
    learned = spread(notation_pairs(pay).filter(F.abs("shift") <= 1.0), anchors, conversions)
    linked = notations.join(learned.withColumnRenamed("factor", "taught"), "notation", "left")

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for n, taught in zip(batch["notation"], batch["taught"]):
                taught = None if pd.isna(taught) else int(taught)
                words = words_of(n)
                stated = bool(words[0]) or taught is not None and bool(words[2])
                found.append(((taught or by_short_forms(n, factors)) if stated else None, taught is not None))
            out = batch[["notation", "rows"]].assign(factor=pd.array([f for f, _ in found], dtype="Int64"), learned=[x for _, x in found])
            yield out[["notation", "factor", "learned", "rows"]]

    return linked.mapInPandas(resolve, "notation string, factor long, learned boolean, rows long").filter("factor IS NOT NULL")


def annual_pay(jobs: DataFrame, units: DataFrame) -> DataFrame:
    """(job_id, currency, annual_min, annual_max) of the jobs whose pay is stated with currency and period."""
    pay = stage(read_pay(jobs), "pay")
    factors = stage(notation_factors(pay, units).select("notation", "factor"), "notations")
    rows = pay.join(broadcast_if_small(factors), "notation", "left")
    sizes = {r["unit"]: int(r["factor"]) for r in units.collect()}
    by_name = F.create_map(*[F.lit(x) for item in sizes.items() for x in item])
    token = F.regexp_extract("notation", r"(?:^| )(k|thousand|l|lakhs?|lacs?|m|mn|million|cr|crores?)(?: |$)", 1)
    own = F.lit(None).cast("bigint")
    for unit, forms in SCALE_FORMS.items():
        if unit in sizes:
            own = F.when(token.isin(*forms.split()), F.lit(sizes[unit])).otherwise(own)
    described = by_name[F.col("said_period")] * F.coalesce(own, by_name[F.col("said_scale")], F.lit(1))
    factor = F.coalesce("factor", described)
    rows = rows.withColumn("by", factor).withColumn("currency", F.coalesce("currency", "said_currency"))
    rows = rows.filter("by IS NOT NULL AND currency IS NOT NULL")
    low, high = (F.round(F.col(c) * F.col("by"), 0).cast("bigint") for c in ("low", "high"))
    return rows.select("job_id", "currency", low.alias("annual_min"), high.alias("annual_max"))
