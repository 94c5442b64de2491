"""Lenient readings of values that a model or a scraper wrote."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def to_number(c: Column) -> Column:
    """The first number in a text: '4+' is 4; null for no number."""
    return F.regexp_extract(c, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def to_score(c: Column) -> Column:
    """0 to 100, half to even, 0 for no number."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.coalesce(to_number(c), F.lit(0.0)), 0).cast("int")))


def to_unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(to_number(c), F.lit(0.0))))


def to_years(c: Column) -> Column:
    n = to_number(c)
    return F.when(n.between(0, 45), n)


def to_words(c: Column) -> Column:
    """A list of texts from one text parted by ; , • or line ends."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,•\n]"), lambda s: F.trim(s)), lambda s: s != "")


def enum_key(c: Column, known: list[str], otherwise: str) -> Column:
    key = F.regexp_replace(F.lower(F.trim(c)), "[ -]", "_")
    return F.when(key.isin(*known), key).otherwise(otherwise)


_DECODER = json.JSONDecoder()
_TRAILING_COMMA = re.compile(r",(\s*[}\]])")


def json_object(text: str | None) -> str | None:
    """The first JSON object that stands in a text, thinking and fences taken off; null without one.

    From each opening brace on, the text is tried as it is, then with curly quotes and trailing commas mended.
    """
    if not text:
        return None
    text = text.rpartition("</think>")[2]
    if "```" in text:
        inner = text.split("```")[1]
        text = inner[4:] if inner[:4].lower() == "json" else inner
    mended = _TRAILING_COMMA.sub(r"\1", text.replace("“", '"').replace("”", '"'))
    # Mending takes no brace away, so the n-th brace is the same in both.
    for places in zip(*[(m.start() for m in re.finditer("{", t)) for t in (text, mended)]):
        for t, at in zip((text, mended), places):
            try:
                return t[at : _DECODER.raw_decode(t, at)[1]]
            except (ValueError, RecursionError):
                pass
    return None


@F.pandas_udf(StringType())
def _salvage(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: json_object(t) if isinstance(t, str) else None)


def salvage_json(c: Column) -> Column:
    """A JSON object out of a model's answer; null where there is none."""
    return _salvage(c)
