"""Whole reports: all stages of a corpus as tables, and all tests of four scored runs as one file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MTLD_THRESHOLD
from ..sources import sinks
from . import corpus as C
from . import stats as Z
from .shared import kept

# The conditions that are compared, by name, and the pairs of each question.
CONDITIONS = ("zeroshot", "lexicon", "lf", "combined")
COMPARISONS = {("RQ1",): ("zeroshot", "lexicon"), ("RQ2",): ("zeroshot", "lf"), ("RQ3a", "lexicon_vs_combined"): ("lexicon", "combined"), ("RQ3a", "lf_vs_combined"): ("lf", "combined")}


def long_form(one: DataFrame) -> DataFrame:
    """metric, value: a row of figures as rows, in the order of its columns."""
    cells = [F.struct(F.lit(i).alias("i"), F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for i, c in enumerate(one.columns)]
    return one.select(F.explode(F.array(*cells)).alias("c")).orderBy("c.i").select("c.metric", "c.value")


def corpus_tables(corpus: DataFrame) -> dict[str, DataFrame]:
    """Every table of the corpus analysis by name; the corpus is read by each, so it is written once first."""
    corpus = kept(corpus)
    pairs, values, columns, operations = C.anchor_pairs(corpus), C.value_rows(corpus), C.column_rows(corpus), C.operation_rows(corpus)
    groups = C.lexical_diversity(corpus)
    whole = C.corpus_diversity(corpus).withColumn("__one", F.lit(1)).join(C.corpus_mtld(corpus).withColumn("__one", F.lit(1)), "__one")
    similar = C.describe(pairs, "jaccard_similarity").withColumn("__one", F.lit(1)).join(C.quartiles(pairs, "jaccard_similarity").withColumn("__one", F.lit(1)), "__one")
    by_group = [C.describe(groups, c).withColumn("measure", F.lit(c)) for c in ("ttr", "mtld")]
    return {
        "dataset_validation": C.validation(corpus),
        "group_size_summary": long_form(C.group_sizes(corpus)),
        "group_lexical_metrics": groups,
        "group_lexical_summary": reduce(DataFrame.unionByName, by_group).select("measure", "n", "mean", "sd", "median", "min", "max"),
        "corpus_lexical_summary": whole.select(F.lit("corpus").alias("level"), "n_tokens", "n_types", "ttr", "mtld", F.lit(MTLD_THRESHOLD).alias("mtld_threshold")),
        "jaccard_anchor_variant": pairs.drop("share"),
        "jaccard_summary": long_form(similar.select("n", "mean", "sd", "median", "q1", "q3", "min", "max")),
        "jaccard_group_means": C.jaccard_means(corpus),
        "value_lexicalization": values,
        "value_lexicalization_summary": long_form(C.value_summary(values)),
        "column_lexicalization": columns,
        "column_lexicalization_summary": C.column_summary(columns),
        "operation_lexicalization": operations,
        "operation_lexicalization_summary": C.operation_summary(operations),
        "corpus_analysis_utterance_level": C.utterance_level(corpus),
    }


def corpus_report(corpus: DataFrame, folder: str) -> dict[str, bool]:
    """All tables as CSV with header, a folder of part files each; by name whether it had rows and so was written."""
    return {name: sinks.csv(df, f"{folder}/{name}.csv", df.columns) for name, df in corpus_tables(corpus).items()}


def _compared(runs: dict[str, DataFrame], first: str, second: str) -> dict:
    by = runs[first].select("run_id", "difficulty")
    pairs = kept(Z.paired(runs[first], runs[second], names=("a", "b")).join(by, "run_id"))
    cells = Z.contingency(pairs, "a", "b").first()
    counts = [cells[k] if cells else 0 for k in "abcd"]
    if not sum(counts):
        return {"mcnemar": Z.mcnemar(*counts), "bootstrap_ci": None, "subgroups": {}}
    return {"mcnemar": Z.mcnemar(*counts), "bootstrap_ci": Z.paired_bootstrap(*counts), "subgroups": Z.subgroups(pairs, "a", "b", "difficulty")}


def statistics(runs: dict[str, DataFrame]) -> dict:
    """All paired tests of the four conditions, each a frame (run_id, difficulty, score): by question, as COMPARISONS names them,
    and the interaction as a difference in differences and as a mixed model. A run_id is its question's number and, behind `_`, the phrasing.
    """
    runs = {name: kept(runs[name].where("score is not null")) for name in CONDITIONS}
    out: dict = {}
    for path, pair in COMPARISONS.items():
        place = out
        for step in path[:-1]:
            place = place.setdefault(step, {})
        place[path[-1]] = _compared(runs, *pair)
    four = Z.paired(*[runs[c] for c in CONDITIONS], names=("z", "l", "f", "c"))
    patterns = Z.did_patterns(four, "z", "l", "f", "c").collect()
    design = Z.stacked(**{c: runs[c].withColumn("question_id", F.regexp_replace("run_id", r"_[^_]*$", "")) for c in CONDITIONS})
    out["RQ3b"] = {"did": Z.did(patterns) if patterns else None, "glmm": Z.mixed_model(design) if patterns else None}
    return out


def statistics_report(spark: SparkSession, runs: dict[str, DataFrame], path: str) -> dict:
    """statistics() as one JSON file; what isn't a number is null there."""
    found = statistics(runs)
    sinks.metadata(spark, found, path)
    return found
