"""Readers at the edge: résumés, profile documents, scraped drops, configuration."""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocandra.sources.config import config_hash, merged_config  # noqa: F401

SHORTEST, LONGEST = 40, 200_000
TEXT_ENDINGS = ("txt", "md", "text")
#: Names under which scrapers deliver a column, in order of preference.
SCRAPED_NAMES = {
    "job_url": ("job_url", "job_url_direct", "link", "url"),
    "title": ("title", "job_title"),
    "company": ("company", "company_name"),
    "description": ("description", "job_description"),
    "location": ("location",),
    "site": ("site", "source"),
    "date_posted": ("date_posted", "posted_date"),
}


def clean_resume(c: Column) -> Column:
    """LF line ends, single blanks, at most one empty line, ``LONGEST`` characters."""
    c = F.regexp_replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "[ \t]+", " ")
    return F.substr(F.trim(F.regexp_replace(c, "\n{3,}", "\n\n")), F.lit(1), F.lit(LONGEST))


def _pdf_text(data: bytes) -> str | None:
    for name in ("fitz", "pypdf"):
        if importlib.util.find_spec(name):
            module = importlib.import_module(name)
            if name == "fitz":
                with module.open(stream=data, filetype="pdf") as pages:
                    return "\n".join(p.get_text() for p in pages)
            return "\n".join(p.extract_text() or "" for p in module.PdfReader(io.BytesIO(data)).pages)
    return None


def resumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, problem) of résumé files: text files as utf-8, pdf files where a pdf library is installed."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, data in zip(batch["path"], batch["content"]):
                ending = p.rsplit(".", 1)[-1].lower()
                if ending in TEXT_ENDINGS:
                    rows.append((p, bytes(data).decode("utf-8", "replace"), None))
                elif ending == "pdf":
                    text = _pdf_text(bytes(data))
                    rows.append((p, text, None if text is not None else "no pdf library"))
                else:
                    rows.append((p, None, f"unknown kind of file: {ending}"))
            yield pd.DataFrame(rows, columns=["path", "text", "problem"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    read_files = files.mapInPandas(read, "path string, text string, problem string").withColumn("text", clean_resume(F.col("text")))
    short = F.col("problem").isNull() & (F.length("text") < SHORTEST)
    return read_files.withColumn("problem", F.when(short, "too short").otherwise(F.col("problem")))


def profile_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, profile_json) of JSON profile files."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("profile_json"))
    return files.select(F.xxhash64("file").alias("id"), "profile_json")


def scraped(frame: DataFrame) -> DataFrame:
    """A scraped drop with its columns under one name each, whatever their case; blanks and NaN are null."""
    have = {c.lower(): c for c in frame.columns}
    known = {n for names in SCRAPED_NAMES.values() for n in names}

    def first(names: tuple[str, ...]) -> Column:
        found = [F.col(f"`{have[n]}`") for n in names if n in have]
        return F.coalesce(*[F.when(F.length(F.trim(c.cast("string"))) > 0, c.cast("string")) for c in found]) if found else F.lit(None).cast("string")

    rest = [F.when(~F.isnan(c), F.col(c)).alias(c.lower()) if t in ("double", "float") else F.col(f"`{c}`").alias(c.lower()) for c, t in frame.dtypes if c.lower() not in known]
    return frame.select(*[first(names).alias(name) for name, names in SCRAPED_NAMES.items()], *rest)


def call_plan(spark: SparkSession, locations: list[str], queries: list[str], most: int = 12) -> DataFrame:
    """(call, location, query): location by location, the first ``most`` calls to a scraper."""
    calls = [(i, place, q) for i, (place, q) in enumerate(((p, q) for p in locations for q in queries), 1)]
    return spark.createDataFrame(calls[:most], "call int, location string, query string")
