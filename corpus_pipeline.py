"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, source mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontam, langid, minhash, mixing, sharding
from tracewright.llm.common import Scratch, checkpointed, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in no language that the model knows: null texts, texts without a letter, and those whose
    kernel with every language is below langid.FLOOR. Where no row is labelled no language is known, and all texts with a letter stay.
    """
    model = langid.learned_from(docs)
    found = langid.identify(docs, model)
    letter = F.coalesce(F.col("text").rlike(langid.LETTER), F.lit(False))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= langid.FLOOR) if model.langs else letter
    return found.where(known).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of least doc_id: five words, Jaccard 0.8.

    Rows that repeat a doc_id with the same text are one document, with the least of its other columns; with
    other texts they are documents of their own. A null doc_id can't be in a group and stays.
    """
    found = minhash.near_duplicates(docs).where("first and doc_id is not null")
    kept = found.groupBy("doc_id", "hash").agg(F.count("*").alias("__times")).select("doc_id", F.col("hash").alias("__hash"), "__times")
    own = docs.where("doc_id is not null").withColumn("__hash", minhash.text_hash(F.col("text"))).join(kept, ["doc_id", "__hash"])
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    several = own.where("__times > 1").groupBy("doc_id", "__hash").agg(F.first("text").alias("text"), F.min(F.struct(F.lit(0).alias("__"), *others)).alias("__others"))
    several = several.select("doc_id", "text", *[F.col("__others")[c].alias(c) for c in others])
    return own.where("__times = 1").select(*docs.columns).unionByName(several).unionByName(docs.where("doc_id is null")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that leak an item of the benchmark.

    Null and empty texts leak nothing and stay; long texts are read whole; rows that repeat leak alike, so all of them go or
    stay; a null doc_id is a document like others. Items without a word are nothing to leak. An empty table, or an
    empty benchmark, leaves the documents as they are.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document comes as often as it is taken, 0 to 2 times.

    Null and empty texts have no words and come with their block, twice at most; long texts are taken whole or not at all; rows
    that repeat are documents of their own; a null source is one source, and a null doc_id hashes as one value. An empty
    table gives an empty one.
    """
    return mixing.mix(docs).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, all columns, with their place in eight shards of near equal bytes.

    A null text has no bytes but its row counts one; a long text is in one shard whole; rows that repeat have places of their own;
    ties in order go by doc_id, nulls first. Columns that are named like those added are replaced. An empty table gives no rows.
    """
    return sharding.shard(docs, shards=8, law="bytes")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Language ID, latent retrieval and sampled splitters are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder for the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            before.clear()
        before = scratch
    out = checkpointed(STAGES[-1][1](spark, docs, sf_dir))
    before.clear()
    return out
