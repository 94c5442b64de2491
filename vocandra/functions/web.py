"""Posting addresses, dates and pay as scraped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that name a posting, date formats in order of trial.
KEPT_PARAMETERS = ("jk", "jv", "currentjobid", "jobid", "id")
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy", "MM/dd/yyyy")
EMPLOYMENT = (("fulltime", "full_time"), ("full-time", "full_time"), ("parttime", "part_time"), ("contract", "contract"), ("temporary", "temporary"), ("internship", "internship"))


def canonical_url(c: Column) -> Column:
    """Scheme and host lower-cased without www., no tracking, no fragment; what isn't a url is only trimmed."""
    url = F.trim(F.coalesce(c, F.lit("")))
    part = lambda i: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?", i)
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    kept = F.filter(F.split(part(4), "&"), lambda p: F.lower(F.substring_index(p, "=", 1)).isin(*KEPT_PARAMETERS) & p.rlike("=."))
    query = F.array_join(kept, "&")
    built = F.concat(F.lower(part(1)), F.lit("://"), host, F.regexp_replace(part(3), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(part(2) != "", built).otherwise(url)


def parse_date(c: Column) -> Column:
    """Day before month where both are possible; null where no format fits."""
    text = F.substr(F.trim(c), F.lit(1), F.lit(19))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]).cast("timestamp_ntz")


def pay_text(low: Column, high: Column, currency: Column, interval: Column) -> Column:
    """``CUR low-high interval``; equal ends once; '' without amounts."""
    a, b = (F.when(F.isnan(x), None).otherwise(x) for x in (low, high))
    a, b = F.format_number(a, 0), F.format_number(b, 0)
    amount = F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat_ws("-", a, b)).otherwise(F.coalesce(a, b))
    word = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.when(amount.isNull(), "").otherwise(F.concat_ws(" ", word(currency), amount, word(interval)))


def employment_of(types: Column) -> Column:
    """Of the scraped list of types; unknown if none is known."""
    joined = F.lower(F.array_join(types, " "))
    out = F.lit("unknown")
    for text, kind in reversed(EMPLOYMENT):
        out = F.when(joined.contains(text), kind).otherwise(out)
    return out
