"""The corpus pipeline: five stages over ``documents``, each calling one operator of slotframe.llm.

Every stage reads what the one before it kept, as Parquet. The first four return the columns of the table
they are given; the last one says in which shard each document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotframe.llm import decontam, langid, minhash, mixing, sharding
from slotframe.llm.common import stored, table

LEAST_SHARE = 1 / 3
"""A text whose likeliest language has a smaller share of it is rejected, as is one without letters."""
SHARDS = 40
ORACLE_SQL = None
"""Language, mixing and differencing have no SQL; tests hold the stages against plain versions."""


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns under names of our own, so that no name of theirs meets one of a result; and the new name of each."""
    names = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def renamed(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(c).alias(name) for name, c in names.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those in no language mainly."""
    model = langid.fit(docs, order_by=F.struct("doc_id", "text"))
    rows, names = numbered(docs)
    found = langid.identify(rows, model, names["text"], keep=tuple(names.values()))
    return renamed(found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id. Of rows that share an id one
    stays; rows without an id stay."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    rows, names = numbered(docs)
    own = names["doc_id"]
    kept = found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias("copies"))
    # Ids are hashed, so texts are shuffled once and not sorted; only ids with several rows need an order.
    named = rows.where(F.col(own).isNotNull()).join(kept.hint("shuffle_hash"), own)
    first = Window.partitionBy(own).orderBy(F.xxhash64(*names.values()))
    repeated = named.where("copies > 1").withColumn("turn", F.row_number().over(first)).where("turn = 1")
    kept = named.where("copies = 1").select(*names.values()).unionByName(repeated.select(*names.values()))
    return renamed(kept.unionByName(rows.where(F.col(own).isNull())), names)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents until each source has its share; every file holds a part of one shard, in its
    seeded order. Texts go along with their rows, so none is looked up again."""
    rows, names = numbered(docs)
    kept = {name: f"k{i}" for i, name in enumerate(names)}
    rows = rows.select("*", *[F.col(names[name]).alias(k) for name, k in kept.items()])
    mixed = mixing.mix(rows, id_col=names["doc_id"], text_col=names["text"], source_col=names["source"], keep=tuple(kept.values()))
    return renamed(mixing.mixture(mixed), kept)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document; equal texts share a shard."""
    return sharding.shard_documents(docs.select("doc_id", "text"), SHARDS)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
