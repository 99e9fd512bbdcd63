"""From raw documents to encoded training tokens: filter, deduplicate, decontaminate, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from couponflow.llm import decontamination, mixing, near_texts, quality, simhash, token_output
from couponflow.llm.tables import read, ship
from couponflow.session import stage, table_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the trees keep."""
    ship(spark)
    trees = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.keep(docs, trees)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with near fingerprints or a five-word similarity of at least 0.8."""
    ship(spark)
    return near_texts.deduplicate(docs, simhash.RADIUS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out, so that sources have their target weights."""
    return mixing.materialize(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as files of coded token ids; returns what the files hold of each document."""
    ship(spark)
    files = table_path(spark, "token-files")
    token_output.write(docs, files)
    return token_output.digests(spark, files)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mix", source_mix),
    ("token output", token_files),
]

#: The trees of the first stage and the token coder of the last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
