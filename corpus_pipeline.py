"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Toxic documents go, then exact copies, then near copies; sources are mixed to their weights,
and what the mix takes is packed into sequences.  A stage takes any columns beside doc_id, text and
source, whatever their names, and keeps them; an empty table gives an empty one.  Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from indexloom.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from indexloom.llm.queries import VOCABULARY
from indexloom.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Intermediate tables of the stage before, whose result has been written when the next one begins.
_BEFORE: list[Scratch] = []


def stage(f: Stage) -> Stage:
    """Removes the tables and lets go of the shuffles of the stage before, then runs ``f``."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        old = [s for s in _BEFORE if s.spark.sparkContext is spark.sparkContext]
        _BEFORE.clear()
        for s in old:
            s.clear()
        if old:
            old[0].release()
        Scratch.opened.clear()
        out = f(spark, docs, sf_dir)
        _BEFORE.extend(Scratch.opened)
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; null and empty texts are not."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id, one of repeated rows; null counts as empty, null ids come last."""
    return exact_dedup.keep_first(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest id; texts without words all stay."""
    return ngram_join.keep_one(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: whole as often as it takes them, and the part that it takes of the last.

    Texts without words take no room and go; a null source is one of its own; repeated rows are documents of their own.
    """
    return mixing.mixed(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document of the mix lies in the sequences; a document that came twice is packed twice."""
    return packing.best_fit(docs, public_tokenizers.path(VOCABULARY), end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Tokenising and the learned score are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    scratch = Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
