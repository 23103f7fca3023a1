"""Registered queries of the library: name to plan, and name to the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import advanced, basic, files

QUERIES: dict = {**basic.QUERIES, **advanced.QUERIES, **files.QUERIES}
SQL: dict = {**basic.SQL, **advanced.SQL, **files.SQL}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly total by region, gap-free, split 70/30 in time, seasonal-naive errors on the held-out months."""
    return advanced.flagship(spark, sf_dir)
