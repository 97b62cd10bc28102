"""From raw documents to packed sequences, in five stages; each stage's decisions hold for all that follow."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.llm import langid, packing, quality, similar, simhash, suffix_dedup
from pagewright.llm.common import drop_scratch, materialize, scratch
from pagewright.session import table

#: A language must be this likely; with few words of shared vocabulary the posterior is spread over all languages.
LEAST_LANGUAGE_SCORE = 0.3
#: Passages of so many words are cut where they repeat.
REPEATED_WORDS = 51


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier, fitted on the labels of the folder, predicts as good."""
    model = quality.learn(*quality.sample(docs, table(spark, sf_dir, "labels")))
    found = quality.score(docs, model, "_quality").where(F.col("_quality") >= quality.THRESHOLD)
    return found.select(*docs.columns)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a recognised language: those without a letter or without a likely language go."""
    found = langid.identify(docs, langid.learn(docs, langid.default_path()), "_lang", "_score")
    return found.where((F.col("_lang") != langid.UNKNOWN) & (F.col("_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, five-word shingles with a Jaccard similarity of 0.8 or more."""
    return simhash.first_of_groups(docs, found=similar.near_duplicates(docs))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts runs of over 50 words, and strings of 400 bytes, that occur more than once; every document stays."""
    return suffix_dedup.without_repeats(docs, REPEATED_WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.query(docs)


#: Scratch tables that the last stage of each session has left, for its result to be read from.
_LEFT: dict[str, list[str]] = {}


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with the scratch tables of the one before it deleted first, unless its documents still come from them."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.pop(key := spark.sparkContext.applicationId, [])
        read = {part for f in docs.inputFiles() for part in f.split("/")[-2:-1]} if left else set()
        if read.isdisjoint(p.rsplit("/", 1)[1] for p in left):
            drop_scratch(spark, left)
            left = []
        with scratch() as made:
            found = stage(spark, docs, sf_dir)
        _LEFT[key] = left + made
        return found

    return run


STAGES = [
    ("quality", _tidy(by_quality)),
    ("language", _tidy(by_language)),
    ("near_duplicates", _tidy(near_duplicates)),
    ("repeated_strings", _tidy(repeated_strings)),
    ("packing", _tidy(packed)),
]
#: Models, components and suffix sorting are beyond SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what is between stages is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
QUERY_SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
