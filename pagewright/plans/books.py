"""Queries over books derived from the documents table (one book per source)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.session import table


def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per book: one page per document of a source."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_pages"))


QUERIES = {"s02_page_count": page_count}
ORACLE_SQL = {"s02_page_count": "SELECT source, count(*) AS n_pages FROM documents GROUP BY source"}
