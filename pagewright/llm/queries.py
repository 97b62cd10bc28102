"""Queries that apply each operator of this subpackage to its whole table."""

from __future__ import annotations

from pagewright.session import table

from . import bpe, covertree, gif, html_extract, langid, packing, quality, sharding, simhash, suffix_dedup

QUERIES = {
    "op1_bpe": lambda spark, d: bpe.query(table(spark, d, "documents")),
    "op2_langid": lambda spark, d: langid.query(table(spark, d, "documents")),
    "op3_gif": lambda spark, d: gif.query(table(spark, d, "documents")),
    "op5_html": lambda spark, d: html_extract.query(table(spark, d, "pages")),
    "op7_packing": lambda spark, d: packing.query(table(spark, d, "documents")),
    "op6_covertree": lambda spark, d: covertree.query(table(spark, d, "embeddings")),
    "op8_quality": lambda spark, d: quality.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_sharding": lambda spark, d: sharding.query(table(spark, d, "documents")),
    "op9_suffix": lambda spark, d: suffix_dedup.query(table(spark, d, "documents")),
    "op10_simhash": lambda spark, d: simhash.query(table(spark, d, "documents")),
}
ORACLE_SQL: dict[str, str] = {}
