"""Text normalisation: descriptions, keys, hashes, sentences, excerpts."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named entities that are decoded, ampersand last; the bullets; suffixes that aren't part of a company key.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&ndash;", "–"), ("&mdash;", "—"), ("&bull;", "•"), ("&euro;", "€"), ("&pound;", "£"), ("&amp;", "&")]
BULLETS = "[•●▪‣⁃]"
COMPANY_SUFFIX = r"\b(pvt\.? ?ltd\.?|private limited|ltd\.?|limited|llc|inc\.?|llp|gmbh|s\.?a\.?|pvt|technologies|technology|solutions|labs?)\b\.?"
SECTION = r"(?i)(requirements?|qualifications?|what you.{0,20}bring|skills? needed|responsibilit(?:y|ies)|what you.{0,20}do|about the role|your profile)"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: Named characters of the HTML 4 standard by the standard library's table, and those above under their own signs.
_NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {e[1:-1]: c for e, c in ENTITIES if not e.startswith("&#")}
_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _character(name: Column) -> Column:
    """What an entity stands for; itself where it is unknown."""
    hexed = F.when(name.rlike("^#[xX]"), F.substr(name, F.lit(3))).otherwise(F.conv(F.substr(name, F.lit(2)), 10, 16))
    code = F.conv(hexed, 16, 10).cast("long")
    valid = name.startswith("#") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    spelt = F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")
    known = F.create_map(*[F.lit(x) for item in _NAMED.items() for x in item])
    return F.when(valid, spelt).otherwise(F.coalesce(F.try_element_at(known, name), F.concat(F.lit("&"), name, F.lit(";"))))


def unescape(c: Column) -> Column:
    """Numeric and named entities decoded, once each: ``&amp;lt;`` becomes ``&lt;``. Texts without any pass untouched."""
    names = F.regexp_extract_all(c, F.lit(_ENTITY), F.lit(1))
    parts = F.split(c, _ENTITY, -1)
    rest = F.zip_with(F.transform(names, _character), F.slice(parts, F.lit(2), F.size(names)), lambda a, b: F.concat(a, b))
    return F.when(c.rlike(_ENTITY), F.concat(parts[0], F.array_join(rest, ""))).otherwise(c)


def clean_description(c: Column) -> Column:
    """Entities, tags, line ends, bullets, blanks: in this order, so that encoded tags go as well. Null gives ''."""
    c = F.regexp_replace(unescape(text_or_empty(c)), "<[^>]+>", " ")
    c = F.regexp_replace(F.replace(c, F.lit("\r"), F.lit("\n")), BULLETS, "\n- ")
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def company_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text_or_empty(c))), COMPANY_SUFFIX, " "), "[^a-z0-9]+", " "))


def title_key(c: Column) -> Column:
    """Inner blanks are kept as they are."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9+ ]+", " "))


def content_hash(company: Column, title: Column, description: Column) -> Column:
    joined = F.concat_ws("|", text_or_empty(company), text_or_empty(title), text_or_empty(description))
    return F.sha2(F.lower(F.trim(F.regexp_replace(joined, r"\s+", " "))), 256)


def skill_text(c: Column) -> Column:
    """Lower-cased, signs other than # + / as blanks."""
    c = F.replace(F.lower(text_or_empty(c)), F.lit("’"), F.lit("'"))
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9#+/ ]+", " "), r"\s+", " "))


def sentences(c: Column) -> Column:
    """Trimmed, non-empty: cut after . ! ? and at line ends and bullets."""
    parts = F.split(c, r"(?<=[.!?])\s+|\n+|[•●▪]")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def excerpt(c: Column, size: int) -> Column:
    """Long texts from their requirements on, with a little before; others whole or cut."""
    # regexp_instr counts UTF-16 units, substr characters; so the position is what stands before the section.
    at = F.when(c.rlike(SECTION), F.length(F.split(c, SECTION, 2)[0]) + 1).otherwise(0)
    start = F.greatest(F.lit(1), at - size // 4)
    head = F.substr(c, start, at - start)
    section = F.substr(F.concat(head, F.lit("\n"), F.substr(c, at, F.lit(size))), F.lit(1), F.lit(size + size // 4))
    return F.when(F.length(c) <= size, c).when((at > 0) & (at - 1 < F.length(c) - 100), section).otherwise(F.substr(c, F.lit(1), F.lit(size)))


def plain_number(c: Column) -> Column:
    """5.0 as 5, 2.5 as 2.5."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")
