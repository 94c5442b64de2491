"""Ordered pattern detection: work mode, employment, seniority, locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in order, the first that fits decides.
WORK_MODES = [
    (r"\bremote\b|work from home|\bwfh\b|work from anywhere|anywhere in india", "remote"),
    (r"\bhybrid\b|partially remote|flexible work", "hybrid"),
    (r"\bon[- ]site\b|\bonsite\b|in[- ]office\b|work from office", "onsite"),
]
EMPLOYMENTS = [
    (r"\binternship\b|\bintern\b|\btrainee\b", "internship"),
    (r"\bpart[- ]time\b", "part_time"),
    (r"\bcontract\b|\bcontractor\b|\bcontractual\b|freelance", "contract"),
    (r"\btemporary\b|\btemp\b", "temporary"),
    (r"\bfull[- ]time\b|\bpermanent\b|\bfulltime\b", "full_time"),
]
SENIORITIES = [
    (r"\bprincipal\b|\bdistinguished\b|\barchitect\b", "principal"),
    (r"\bmanager\b|\bmanagement\b|\bhead of\b|\bdirector\b|\bvp\b|\bvice president\b", "manager"),
    (r"\bstaff\b", "staff"),
    (r"\blead\b|\bteam lead\b|\btech lead\b|\btechlead\b", "lead"),
    (r"\bsenior\b|\bseniority\b|\bsr\.?\b|\bsnr\b", "senior"),
    (r"\bjunior\b|\bjr\.?\b", "junior"),
    (r"\bentry[- ]level\b|\bgraduate\b|\bfresher\b|\btrainee\b|\bassociate\b", "entry"),
    (r"\bintern\b|\binternship\b|\bintern ship\b|\bco-?op\b|\bapprentice\b", "intern"),
    (r"\biv\s*$|\biii\s*$", "senior"),
    (r"\bii\s*$", "mid"),
    (r"\bi\s*$", "entry"),
]
RANKS = ("intern", "entry", "junior", "mid", "senior", "lead", "staff", "principal", "manager")


def first_match(text: Column, patterns: list[tuple[str, str]], otherwise: Column) -> Column:
    out = otherwise
    for pattern, value in reversed(patterns):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def _joined(*texts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *texts))


def work_mode(*texts: Column) -> Column:
    return first_match(_joined(*texts), WORK_MODES, F.lit("unknown"))


def employment_type(*texts: Column) -> Column:
    return first_match(_joined(*texts), EMPLOYMENTS, F.lit("unknown"))


def seniority(title: Column) -> Column:
    """An unmarked title is mid; a missing one unknown."""
    text = F.lower(F.regexp_replace(F.trim(title), r"\s+", " "))
    return F.when(F.coalesce(F.trim(title), F.lit("")) == "", "unknown").otherwise(first_match(text, SENIORITIES, F.lit("mid")))


def seniority_from_years(total: Column, relevant: Column) -> Column:
    years = F.when(relevant > 0, relevant).otherwise(total)
    out = F.when(years > 0, "entry").otherwise("unknown")
    for least, level in ((1, "junior"), (2.5, "mid"), (5, "senior"), (8, "lead"), (12, "staff")):
        out = F.when(years >= least, level).otherwise(out)
    return out


def seniority_rank(level: Column) -> Column:
    """-1 for unknown."""
    out = F.lit(-1)
    for rank, name in enumerate(RANKS):
        out = F.when(level == name, rank).otherwise(out)
    return out


def rank_gap(wanted: Column, own: Column) -> Column:
    """How many levels the wanted one is above one's own; 0 where one is unknown."""
    a, b = seniority_rank(wanted), seniority_rank(own)
    return F.when((a >= 0) & (b >= 0), a - b).otherwise(0)


def shares_words(a: Column, b: Column) -> Column:
    """Whether two titles have a word in common."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}+#]+"), lambda w: w != "")
    return F.arrays_overlap(words(a), words(b))
