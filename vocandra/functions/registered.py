"""The engine's functions under SQL names, for sessions that query by SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from vocandra.functions import coerce

#: Functions that SQL itself can express: name, parameters, type, body.
EXPRESSIONS = [
    ("first_number", "t STRING", "DOUBLE", r"try_cast(regexp_extract(t, '-?\\d+(?:\\.\\d+)?', 0) AS DOUBLE)"),
    ("plain_number", "x DOUBLE", "STRING", r"regexp_replace(CAST(x AS STRING), '\\.0$', '')"),
    ("rescaled", "x DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN high <= low THEN 50D ELSE greatest(0D, least(100D, 100 * (x - low) / (high - low))) END"),
]


def register(spark: SparkSession) -> list[str]:
    """Registers all functions in the session; returns their names."""
    spark.udf.register("salvaged_json", coerce._salvage)
    for name, parameters, kind, body in EXPRESSIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return ["salvaged_json", *[name for name, *_ in EXPRESSIONS]]
