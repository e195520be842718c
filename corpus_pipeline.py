"""Corpus pipeline: filter toxic documents, near duplicates and benchmark leaks, mix the sources, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``.  All stages but the last return the columns of their
input as they are.  Nulls, repeated rows and empty tables are treated as the operators say.  Of rows that are equal in
what an operator looks at, the order of all their columns decides, never chance.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from blockloom.llm import shared
from blockloom.llm.decontam import contaminated_out
from blockloom.llm.mixing import mix, source_key
from blockloom.llm.neardup import near_duplicates, row_key
from blockloom.llm.sharding import sharded
from blockloom.llm.toxicity import toxic_out

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Up to so many dropped rows are broadcast as 64-bit keys; more are joined by a shuffle.
BROADCAST_DROPPED = 1_000_000
SHARDS = 8


def all_columns(docs: DataFrame, prefix: str = "") -> list:
    """An order of rows by all columns that have one."""
    return [F.col(f"{prefix}`{name}`") for name, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]


def sweeping(stage: Stage) -> Stage:
    """A stage's intermediate tables go when the next one starts: its result is stored by then."""

    @functools.wraps(stage)
    def swept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        mine = shared.WRITTEN
        shared.sweep(spark, mine.held)
        before = len(mine.tables)
        out = stage(spark, docs, sf_dir)
        mine.held = mine.tables[before:]
        del mine.tables[before:]
        return out

    return swept


@sweeping
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go."""
    return toxic_out(docs, shared.read_table(spark, sf_dir, "labels"))


@sweeping
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: that of the smallest id, null ids last."""
    groups = near_duplicates(docs, k=5, percent=80).where("n_shingles > 0")
    dropped = shared.cut(groups.where("not stays").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct())
    twice = shared.cut(groups.where("stays").groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.count("*").alias("n")).where("n > 1"))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_DROPPED else df
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col("doc_id").cast("long").alias("__own"), row_key("doc_id", "text").alias("__key"))
    same = lambda other: rows["__own"].eqNullSafe(other["__id"]) & (rows["__key"] == other["__row"])
    kept = rows.join(small(dropped), same(dropped), "left_anti")
    if not twice.limit(1).count():
        return kept.select("__doc.*")
    twice = small(twice)
    first = Window.partitionBy("__own", "__key").orderBy(*all_columns(docs, "__doc."))
    one = rows.join(twice, same(twice), "left_semi").withColumn("__nth", F.row_number().over(first)).where("__nth = 1")
    return kept.join(twice, same(twice), "left_anti").select("__doc.*").union(one.select("__doc.*"))


@sweeping
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row (or a whole shorter item) with the benchmark go."""
    return contaminated_out(docs, shared.read_table(spark, sf_dir, "benchmark"))


@sweeping
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target asks for, whole ones, in training order."""
    key = ["__id", "__crc", "__source"]
    plan = mix(docs, whole_documents=True).select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), F.col("source_key").alias("__source"), "positions")
    plan = plan.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy("positions"))).where(F.size("positions") > 0)
    plan = plan.select(*(F.col(c).alias(f"{c}_") for c in key), F.col("__nth").alias("__nth_"), F.col("positions").alias("__positions"))
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc")
    rows = docs.select(own, F.col("doc_id").alias("__id"), shared.text_crc32(F.col("text")).alias("__crc"), source_key(F.col("source")).alias("__source"))
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy(*all_columns(docs, "__doc."))))
    timed = rows.join(plan, functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in [*key, "__nth"]]))
    read = timed.select("__doc", F.explode("__positions").alias("__at"), "__id")
    return read.repartitionByRange(shared.partitions(spark), "__at", "__id").sortWithinPartitions("__at", "__id").select("__doc.*")


@sweeping
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard and slot."""
    return sharded(docs, SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: SQL can't express the language models or the signatures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = shared.read_table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        path = shared.new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        shared.sweep(spark, last)
        docs, last = spark.read.parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
