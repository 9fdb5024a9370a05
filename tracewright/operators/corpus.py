"""Stages of corpus analysis over utterances (utterance_id, group_id, position, question, gold_sql, ...).

position 0 is the anchor of a group. Each stage is a frame from a frame; figures are rounded as the
published ones are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sqltext as X
from ..functions import text as T
from . import mtld
from .order import running


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole to 2 digits; 0 where whole is 0."""
    return F.round(100 * F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 2)


def _at_ranks(df: DataFrame, value: str, **ranks: str) -> DataFrame:
    """One row: the values at ranks, from 0, of the sorted values that aren't null; each rank an expression of their number `total`.

    Different values are counted, and these counts summed up in order over range partitions: no task holds them all.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    ranked = running(counts, "k", "v")
    return ranked.agg(*[F.min(F.when(F.col("upto") > F.expr(rank), F.col("v"))).alias(name) for name, rank in ranks.items()])


def describe(df: DataFrame, value: str) -> DataFrame:
    """mean, median, sd (sample; 0 for one value), min, max, to 6 digits; null without rows."""
    v = F.col(value)
    sd = F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v))
    sums = df.agg(*[c.alias(n) for n, c in (("mean", F.avg(v)), ("sd", sd), ("min", F.min(v)), ("max", F.max(v)), ("n", F.count(v)))])
    middle = _at_ranks(df, value, lower="(total - 1) div 2", upper="total div 2").select(((F.col("lower") + F.col("upper")) / 2).alias("median"))
    # one row beside one row
    both = sums.withColumn("__one", F.lit(1)).join(middle.withColumn("__one", F.lit(1)), "__one")
    return both.select(*[F.round(c, 6).alias(c) for c in ("mean", "median", "sd", "min", "max")], "n")


def quartiles(df: DataFrame, value: str) -> DataFrame:
    """q1, q3 by nearest rank: the values at n // 4 and 3 n // 4 of the sorted list, from 0."""
    return _at_ranks(df, value, q1="total div 4", q3="3 * total div 4")


def positions(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with position (from 0 in its group, by the number in `order`) and utterance_id group_position."""
    at = F.row_number().over(W.partitionBy(group).orderBy(F.col(order).cast("int"))) - 1
    return rows.withColumn("position", at).withColumn("utterance_id", F.concat_ws("_", F.col(group).cast("string"), "position"))


def build(dev: DataFrame, gold: DataFrame, meta: DataFrame) -> DataFrame:
    """The corpus: dev(id, question, query, group_id, u_class), gold(id, gold_sql), meta(id, spider_class, domain_value_class).

    Gold SQL by id, else by line where both have it, else that of dev; class `no_hardness` where meta has none. With a
    column `utterance` meta's rows of an empty one are left out, before anything is counted.
    """
    group = F.coalesce("group_id", T.group_of(F.col("id")))
    if "utterance" in meta.columns:
        meta = meta.where(F.trim(F.coalesce("utterance", F.lit(""))) != "").drop("utterance")
    out = dev.join(gold.select("id", "gold_sql"), "id", "left")
    if "line" in dev.columns and "line" in gold.columns:
        by_line = gold.select(F.col("line").cast("long").alias("line"), F.col("gold_sql").alias("__by_line"))
        out = out.join(by_line, "line", "left").withColumn("gold_sql", F.coalesce("gold_sql", "__by_line"))
    out = out.join(meta, "id", "left")
    return out.select(
        F.col("id").alias("utterance_id"), group.alias("group_id"), F.substring_index("id", "_", -1).cast("int").alias("position"), "question",
        F.coalesce("gold_sql", "query", F.lit("")).alias("gold_sql"), F.coalesce("u_class", F.lit("")).alias("u_class"),
        F.coalesce("spider_class", F.lit("no_hardness")).alias("spider_class"), "domain_value_class",
    )


def unmatched(dev: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of dev whose id the other table lacks."""
    return dev.join(other.select("id"), "id", "left_anti")


def validation(corpus: DataFrame) -> DataFrame:
    """Stage 1: group_id, n_utterances, n_distinct_gold_sql, gold_sql_consistent, gold_sql_sample (200 characters of the first)."""
    kinds = F.countDistinct(X.spaced(F.col("gold_sql")))
    out = corpus.groupBy("group_id").agg(F.count("*").alias("n_utterances"), kinds.alias("n_distinct_gold_sql"), F.min_by("gold_sql", "position").alias("sql"))
    return out.select("group_id", "n_utterances", "n_distinct_gold_sql", (F.col("n_distinct_gold_sql") == 1).alias("gold_sql_consistent"), F.substring("sql", 1, 200).alias("gold_sql_sample"))


def group_sizes(corpus: DataFrame) -> DataFrame:
    return describe(corpus.groupBy("group_id").agg(F.count("*").alias("size")), "size")


def _ordered_tokens(corpus: DataFrame, by: str | None) -> DataFrame:
    rows = corpus.select("group_id", "position", T.tokens("question").alias("toks"))
    listed = F.sort_array(F.collect_list(F.struct("group_id", "position", "toks")))
    grouped = rows.groupBy(by) if by else rows.groupBy()
    return grouped.agg(F.count("*").alias("n_utterances"), F.flatten(F.transform(listed, lambda x: x["toks"])).alias("toks"))


def lexical_diversity(corpus: DataFrame) -> DataFrame:
    """Stage 2 by group: n_utterances, n_tokens, n_types, ttr, mtld over the group's utterances in order."""
    out = _ordered_tokens(corpus, "group_id")
    toks = F.col("toks")
    return out.select("group_id", "n_utterances", F.size(toks).alias("n_tokens"), F.size(F.array_distinct(toks)).alias("n_types"), F.round(T.ttr(toks), 6).alias("ttr"), F.round(T.mtld(toks), 4).alias("mtld"))


def corpus_diversity(corpus: DataFrame) -> DataFrame:
    """Stage 2 for the whole corpus, but MTLD: token and type counts need no order, so they are counted apart."""
    each = corpus.select(F.explode(T.tokens("question")).alias("t")).groupBy("t").agg(F.count("*").alias("k"))
    n = F.coalesce(F.sum("k"), F.lit(0))
    return each.agg(n.alias("n_tokens"), F.count("*").alias("n_types")).withColumn("ttr", F.round(F.coalesce(F.try_divide("n_types", "n_tokens"), F.lit(0.0)), 6))


def corpus_mtld(corpus: DataFrame, block: int = mtld.BLOCK) -> DataFrame:
    """MTLD of all utterances in order, by blocks of tokens (`mtld`); 0 below two tokens or without any factor."""
    rows = corpus.select(F.col("group_id").cast("int").alias("g"), "position", T.tokens("question").alias("toks"))
    n, forwards, backwards = mtld.factors(mtld.placed_tokens(rows, "g", "position"), block)
    mean = (forwards + backwards) / 2
    value = n / mean if n >= 2 and mean > 0 else 0.0
    return corpus.sparkSession.range(1).select(F.round(F.lit(value), 4).alias("mtld"))


def anchor_pairs(corpus: DataFrame) -> DataFrame:
    """Stage 3: each variant with its group's anchor: group_id, position, jaccard_similarity and the unrounded share."""
    toks = corpus.select("group_id", "position", T.token_set("question").alias("toks"))
    anchors = toks.where("position = 0").select("group_id", F.col("toks").alias("anchor"))
    pairs = toks.where("position > 0").join(anchors, "group_id")
    share = F.try_divide(F.size(F.array_intersect("anchor", "toks")), F.size(F.array_union("anchor", "toks")))
    return pairs.select("group_id", "position", F.coalesce(share, F.lit(0.0)).alias("share")).withColumn("jaccard_similarity", F.round("share", 6))


def jaccard_means(corpus: DataFrame) -> DataFrame:
    """group_id, n_comparisons, mean_jaccard (null without variants); groups without an anchor are left out."""
    anchors = corpus.where("position = 0").select("group_id").distinct()
    means = anchor_pairs(corpus).groupBy("group_id").agg(F.count("*").alias("n"), F.round(F.avg("share"), 6).alias("mean_jaccard"))
    return anchors.join(means, "group_id", "left").select("group_id", F.coalesce("n", F.lit(0)).alias("n_comparisons"), "mean_jaccard")


def value_rows(corpus: DataFrame) -> DataFrame:
    """Stage 4.1: a row for each literal but the numeric 1: literal_value, value_type, value_lexicalized."""
    each = corpus.select("utterance_id", "group_id", "question", F.explode(X.literals(F.col("gold_sql"))).alias("l"))
    each = each.where(~((F.col("l.value_type") == "numeric") & (F.col("l.literal") == "1")))
    return each.select("utterance_id", "group_id", F.col("l.literal").alias("literal_value"), F.col("l.value_type").alias("value_type"), X.value_named(F.col("l"), F.col("question")).alias("value_lexicalized"))


def value_summary(values: DataFrame) -> DataFrame:
    n, lex = F.count("*"), F.count_if("value_lexicalized")
    out = values.agg(F.countDistinct("utterance_id").alias("applicable_utterances"), n.alias("total_literal_instances"), lex.alias("n_lexicalized"), (n - lex).alias("n_not_lexicalized"))
    t = F.col("total_literal_instances")
    return out.withColumn("pct_lexicalized", percent(F.col("n_lexicalized"), t)).withColumn("pct_not_lexicalized", percent(F.col("n_not_lexicalized"), t))


def column_rows(corpus: DataFrame) -> DataFrame:
    """Stage 4.2: a row for each utterance and column: sql_references_column, column_lexicalized (null: not referenced)."""
    # what several expressions read is a column of its own, so that it is made once a row
    out = corpus.withColumns({"__plain": X.without_literals(F.col("gold_sql")), "__toks": T.tokens("question")})
    out = out.withColumn("refs", X.referenced_columns(F.col("gold_sql"), F.col("__plain")))
    cells = [F.struct(F.lit(c).alias("column"), F.array_contains("refs", c).alias("ref"), X.names_column(F.col("question"), c, F.col("__toks")).alias("lex")) for c in X.TARGET_COLUMNS]
    out = out.select("utterance_id", "group_id", F.explode(F.array(*cells)).alias("c"))
    return out.select("utterance_id", "group_id", "c.column", F.col("c.ref").alias("sql_references_column"), F.when(F.col("c.ref"), F.col("c.lex")).alias("column_lexicalized"))


def operation_rows(corpus: DataFrame) -> DataFrame:
    """Stage 4.3: a row for each utterance and operation: operation_present_in_sql, has_nl_cue (null: not present)."""
    out = corpus.withColumn("__plain", X.without_literals(F.upper("gold_sql")))
    out = out.withColumn("ops", X.operations(F.col("gold_sql"), F.col("__plain")))
    # a cue is sought only where the operation is there
    cells = [F.struct(F.lit(o).alias("sql_operation"), F.col("ops")[o].alias("there"), F.when(F.col("ops")[o], X.has_cue(F.col("question"), o)).alias("cue")) for o in X.OPERATION_CUES]
    out = out.select("utterance_id", "group_id", F.explode(F.array(*cells)).alias("c"))
    return out.select("utterance_id", "group_id", "c.sql_operation", F.col("c.there").alias("operation_present_in_sql"), F.col("c.cue").alias("has_nl_cue"))


def _rates(rows: DataFrame, key: str, there: str, named: str, names: tuple[str, str, str]) -> DataFrame:
    """Counts and rate by key and, from the sums, OVERALL; keys without an occurrence have 0."""
    n, k = F.count_if(there), F.count_if(F.coalesce(F.col(named), F.lit(False)))
    out = rows.rollup(key).agg(n.alias("n"), k.alias("k"))
    return out.select(F.coalesce(key, F.lit("OVERALL")).alias(key), F.col("n").alias(names[0]), F.col("k").alias(names[1]), (F.col("n") - F.col("k")).alias(names[2]), percent(F.col("k"), F.col("n")).alias("lexicalization_rate_pct"))


def column_summary(rows: DataFrame) -> DataFrame:
    return _rates(rows, "column", "sql_references_column", "column_lexicalized", ("references", "lexicalized", "not_lexicalized"))


def operation_summary(rows: DataFrame) -> DataFrame:
    return _rates(rows, "sql_operation", "operation_present_in_sql", "has_nl_cue", ("occurrences", "explicit_cue", "no_explicit_cue"))


def utterance_level(corpus: DataFrame) -> DataFrame:
    """One row for each utterance with all dimensions; names joined by semicolons in their fixed order."""
    q = F.col("question")
    lits = F.filter(X.literals(F.col("gold_sql")), lambda x: ~((x["value_type"] == "numeric") & (x["literal"] == "1")))
    out = corpus.withColumns({"__l": lits, "__p": X.without_literals(F.col("gold_sql")), "__u": X.without_literals(F.upper("gold_sql")), "__t": T.tokens("question")})
    out = out.withColumns({"__c": X.referenced_columns(F.col("gold_sql"), F.col("__p")), "__o": X.operations(F.col("gold_sql"), F.col("__u"))})
    named = F.array_compact(F.array(*[F.when(F.array_contains("__c", c) & X.names_column(q, c, F.col("__t")), c) for c in X.TARGET_COLUMNS]))
    there = F.array_compact(F.array(*[F.when(F.col("__o")[o], o) for o in X.OPERATION_CUES]))
    cued = F.array_compact(F.array(*[F.when(F.col("__o")[o] & X.has_cue(q, o), o) for o in X.OPERATION_CUES]))
    # what is joined and counted is a column of its own, so that it is made once a row
    out = out.withColumns({"__named": named, "__there": there, "__cued": cued})
    named, there, cued = map(F.col, ("__named", "__there", "__cued"))
    hits = F.size(F.filter("__l", lambda x: X.value_named(x, q)))
    joined = lambda c: F.array_join(c, ";")
    extra = [c for c in ("u_class", "spider_class") if c in corpus.columns]
    return out.select(
        "utterance_id", "group_id", "question", "gold_sql", *extra, F.size("__l").alias("val_n_literals"), hits.alias("val_n_lexicalized"), (F.size("__l") > 0).alias("val_applicable"),
        joined(F.col("__c")).alias("cols_referenced"), joined(named).alias("cols_lexicalized"), F.size("__c").alias("n_cols_referenced"), F.size(named).alias("n_cols_lexicalized"),
        joined(there).alias("ops_present"), joined(cued).alias("ops_with_cue"), F.size(there).alias("n_ops_present"), F.size(cued).alias("n_ops_with_cue"),
    )
