"""Command line: `python -m tracewright run | rescore | corpus | stats`. Options can stand in a JSON file; those given win over it."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import corpus, pipeline, reports
from .sources import readers
from .sources.generators import generator


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tracewright")
    parser.add_argument("--config", help="a JSON file of options")
    parts = parser.add_subparsers(dest="part", required=True)
    for part in ("run", "rescore"):
        p = parts.add_parser(part, argument_default=argparse.SUPPRESS)
        for f in fields(pipeline.RunConfig):
            kind = {"bool": None, "float": float, "int": int, "int | None": int}.get(f.type, str)
            p.add_argument(f"--{f.name}", **({"action": "store_true"} if f.type == "bool" else {"type": kind}))
        p.add_argument("--log", help="the event log, Parquet")
    runs, again = parts.choices["run"], parts.choices["rescore"]
    runs.add_argument("--dev", help="questions, JSON")
    runs.add_argument("--gold", help="gold statements")
    runs.add_argument("--hardness", help="scores whose difficulty is taken")
    runs.add_argument("--prebuilt", help="prompts by id, JSON")
    again.add_argument("--predictions")
    again.add_argument("--folder")
    p = parts.add_parser("corpus", argument_default=argparse.SUPPRESS)
    for name in ("dev", "gold", "meta", "out"):
        p.add_argument(f"--{name}")
    p = parts.add_parser("stats", argument_default=argparse.SUPPRESS)
    for name in (*reports.CONDITIONS, "out"):
        p.add_argument(f"--{name}")
    given = parser.parse_args(argv)
    if given.config:
        with open(given.config) as file:
            for k, v in json.load(file).items():
                if not hasattr(given, k):
                    setattr(given, k, v)
    return given


def _config(given: argparse.Namespace) -> pipeline.RunConfig:
    return pipeline.RunConfig(**{f.name: getattr(given, f.name) for f in fields(pipeline.RunConfig) if hasattr(given, f.name)})


def _gold(spark: SparkSession, path: str) -> DataFrame:
    return readers.gold_file(spark, path)[0]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = _arguments(argv)
    spark = spark or SparkSession.builder.appName("tracewright").getOrCreate()
    if given.part in ("run", "rescore"):
        cfg = _config(given)
        readers.register(readers.event_log(spark, given.log))
    if given.part == "run":
        more = {"hardness": readers.score_tsv(spark, given.hardness).select(F.col("run_id").alias("id"), F.col("difficulty").alias("hardness"))} if hasattr(given, "hardness") else {}
        more |= {"prebuilt": readers.prebuilt_prompts(spark, given.prebuilt)} if hasattr(given, "prebuilt") else {}
        samples = pipeline.load(readers.dev_json(spark, given.dev), _gold(spark, given.gold), **more)
        print(json.dumps(pipeline.run(spark, samples, generator(cfg), cfg, given.dev), indent=2))
    elif given.part == "rescore":
        scored = pipeline.rescore(spark, given.predictions, cfg, getattr(given, "folder", None))
        scored.agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in ("em", "ex") if m in scored.columns]).show()
    elif given.part == "corpus":
        meta = readers.header_tsv(spark, given.meta)
        print(json.dumps(reports.corpus_report(corpus.build(readers.dev_json(spark, given.dev), _gold(spark, given.gold), meta), given.out), indent=2))
    else:
        runs = {c: readers.score_tsv(spark, getattr(given, c)) for c in reports.CONDITIONS}
        reports.statistics_report(spark, runs, given.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
