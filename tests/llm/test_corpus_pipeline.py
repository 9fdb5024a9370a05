"""The pipeline stage by stage, each on what the one before it kept."""

from collections import Counter

import corpus_pipeline as P
from pyspark.sql import functions as F

from tracewright.llm import decontam


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(10**7, None, "en", "src0", 0), (10**7 + 1, "1234 ...", "en", "src0", 8), (None, "Words of a row without an id", "en", None, 9)], docs.schema)
    docs = docs.union(extra).union(docs.where("doc_id = 3"))
    columns, counts = docs.columns, []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
        if name == "language_id":
            assert before.count() - counts[-1] == 2
        if name == "near_dedup":
            assert docs.where("doc_id is null").count() == 1
            assert docs.where("doc_id is not null").select("doc_id").distinct().count() == counts[-1] - 1
        if name == "decontamination":
            assert decontam.leaks(docs, spark.read.parquet(f"{small}/benchmark.parquet")).count() == 0
            gone = {r["doc_id"] for r in before.select("doc_id").subtract(docs.select("doc_id")).collect()}
            assert gone == {r["doc_id"] for r in decontam.leaks(before, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
        if name == "source_mix":
            words = lambda df: df.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
            assert 1.3 < words(docs) / words(before) < 1.7
            assert max(Counter(r["doc_id"] for r in docs.select("doc_id").collect()).values()) <= 2
    sizes = [r["s"] for r in docs.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.6 * min(sizes)
    assert counts[0] >= counts[1] >= counts[2] and counts[3] == counts[4]


def test_run_is_the_stages(spark, small):
    out = P.run(spark, small)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 0


def test_only_documents_of_no_known_language_are_rejected(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert P.language_id(spark, docs, small).count() == docs.count()
    odd = [(1, None, "en", "s", 0), (2, "12 34 ...", "en", "s", 9), (3, "日本語のテキストです", "ja", "s", 10), (4, "Привет как дела сегодня", None, "s", 23), (5, "a plain text, as others", None, "s", 20)]
    new = [(10**7 + i, *r) for i, *r in odd]
    kept = P.language_id(spark, docs.where("lang is not null").union(spark.createDataFrame(new[1:], docs.schema).withColumn("lang", F.lit(None).cast("string"))), small)
    assert {r["doc_id"] - 10**7 for r in kept.where("doc_id > 5000000").collect()} == {5}
    # without a label no language is known, so only texts without a letter go
    bare = spark.createDataFrame(odd, docs.schema).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] for r in P.language_id(spark, bare, small).collect()) == [3, 4, 5]


def test_near_dedup_keeps_unlike_texts_of_one_id(spark):
    words = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, words("a"), "en", "s", 1), (2, words("a") + " more", "en", "s", 2), (2, words("b"), "en", "s", 3), (3, words("c"), "fr", "t", 5), (3, words("c"), "en", "s", 4), (4, words("d") + " x", "en", "s", 6), (4, words("d"), "en", "s", 7), (5, None, "en", "s", 8), (5, "", "en", "s", 9), (None, words("a"), "en", "s", 10)]
    seen = []
    for order in (rows, rows[::-1], rows[4:] + rows[:4]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        seen.append(sorted(map(tuple, P.near_dedup(spark, docs, "").collect()), key=str))
    # of the two like texts of document 4 one stays, of the equal rows of document 3 that of least other columns
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 7
    assert {(r[0], r[4]) for r in seen[0]} >= {(1, 1), (2, 3), (3, 4), (5, 8), (5, 9), (None, 10)} and sum(r[0] == 4 for r in seen[0]) == 1
