"""Queries of the unit harmonisation (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vocandra.operators.units import annual_pay, notation_factors, read_pay
from vocandra.session import stage, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annual_pay(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "pay_units"))


def p4_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notation_factors(stage(read_pay(table(spark, sf_dir, "jobs")), "pay"), table(spark, sf_dir, "pay_units"))


QUERIES = {"p4_found": p4_found, "p4_notations": p4_notations}
