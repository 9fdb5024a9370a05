"""Queries of evaluation and statistics, each with the SQL that DuckDB runs.

Paired scores: quality and toxic of labels are two conditions of a document, its language the
difficulty, its source the question; flags of lineitem give four conditions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import stats as Z
from .eventlog_sql import DUCK_LOG, event_log

QUERIES: dict = {}
ORACLES: dict = {}


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("difficulty"), F.col("source").alias("question_id"))
    kind = F.when(F.col("doc_id") % 5 == 0, "base").otherwise("paraphrase")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("run_id"), "difficulty", "question_id", kind.alias("kind"), "quality", "toxic")


_S = "s AS (SELECT l.doc_id AS run_id, d.lang AS difficulty, d.source AS question_id, CASE WHEN l.doc_id % 5 = 0 THEN 'base' ELSE 'paraphrase' END AS kind, quality, toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scores of a line item."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    flags = {"z": F.col("l_returnflag") == "N", "l": F.col("l_linestatus") == "O", "f": F.col("l_discount") > 0.05, "c": F.col("l_quantity") > 20}
    return rows.select(*[c.cast("int").alias(k) for k, c in flags.items()], F.col("l_orderkey").alias("question_id"))


_C = "c4 AS (SELECT CAST(l_returnflag = 'N' AS INT) AS z, CAST(l_linestatus = 'O' AS INT) AS l, CAST(l_discount > 0.05 AS INT) AS f, CAST(l_quantity > 20 AS INT) AS c, l_orderkey AS question_id FROM lineitem)"


def _add(name: str, make, sql: str | None, source=scores, view: str = _S) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(source(spark, sf_dir))
    if sql:
        ORACLES[name] = f"WITH {view}{sql if sql.startswith(',') else ' ' + sql}"


_cells = "count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic <> 1) AS b, count(*) FILTER (quality <> 1 AND toxic = 1) AS c, count(*) FILTER (quality <> 1 AND toxic <> 1) AS d, count(*) AS n"
_add("st_contingency", lambda s: Z.contingency(s, "quality", "toxic"), f"SELECT {_cells} FROM s")
_add("st_contingency_by", lambda s: Z.contingency(s, "quality", "toxic", "difficulty"), f"SELECT difficulty, {_cells} FROM s GROUP BY difficulty")


def _mcnemar(s: DataFrame) -> DataFrame:
    cells = Z.contingency(s, "quality", "toxic", "difficulty").where("n >= 2")
    rows = [(r["difficulty"], *(lambda m: (m["n_discordant"], m["statistic"], m["method"], round(m["delta"], 9)))(Z.mcnemar(r["a"], r["b"], r["c"], r["d"]))) for r in cells.collect()]
    out = s.sparkSession.createDataFrame(rows, "difficulty string, nd long, statistic double, method string, delta double")
    return out.withColumn("statistic", F.round("statistic", 9))


_add(
    "st_mcnemar",
    _mcnemar,
    f", k AS (SELECT difficulty, {_cells} FROM s GROUP BY difficulty) SELECT difficulty, b + c AS nd, CASE WHEN b + c = 0 THEN 0 WHEN b + c >= 25 THEN round((abs(b - c) - 1) ** 2 / (b + c), 9) END AS statistic, CASE WHEN b + c = 0 THEN 'exact (no discordant pairs)' WHEN b + c < 25 THEN 'exact binomial McNemar' ELSE 'chi-squared with continuity correction' END AS method, round((c - b)::DOUBLE / n, 9) AS delta FROM k WHERE n >= 2",
)
def _exact(s: DataFrame) -> DataFrame:
    """The exact test of each question, with its p-value, from the cells of all."""
    cells = Z.contingency(s, "quality", "toxic", "question_id", "difficulty").where("n >= 2 and b + c > 0 and b + c < 25")
    rows = [(r["question_id"], r["difficulty"], (m := Z.mcnemar(r["a"], r["b"], r["c"], r["d"]))["n_discordant"], m["p_value"], m["significant"]) for r in cells.collect()]
    return s.sparkSession.createDataFrame(rows, "question_id string, difficulty string, nd long, p_value double, significant boolean").withColumn("p_value", F.round("p_value", 9))


_add(
    "st_mcnemar_exact",
    _exact,
    f", k AS (SELECT question_id, difficulty, {_cells} FROM s GROUP BY ALL), t AS (SELECT *, b + c AS nd, unnest(range(0, least(b, c) + 1)) AS i FROM k WHERE n >= 2 AND b + c > 0 AND b + c < 25), p AS (SELECT question_id, difficulty, nd, round(least(1, 2 * sum(factorial(CAST(nd AS INT))::DOUBLE / (factorial(CAST(i AS INT))::DOUBLE * factorial(CAST(nd - i AS INT))::DOUBLE) / 2 ** nd)), 9) AS p_value FROM t GROUP BY ALL) SELECT *, p_value < 0.05 AS significant FROM p",
)


def _subgroups(s: DataFrame) -> DataFrame:
    """What doesn't depend on the draws of each subgroup's tests: sizes, accuracies and their difference, as the test and the bootstrap see it."""
    found = Z.subgroups(s, "quality", "toxic", "difficulty")
    rows = [(k, v["n_items"], round(v["acc_A"], 9), round(v["acc_B"], 9), round(v["delta"], 9), round(v["boot_obs_delta"], 9), v["boot_ci_lo"] <= v["boot_ci_hi"]) for k, v in found.items()]
    return s.sparkSession.createDataFrame(rows, "difficulty string, n_items long, acc_a double, acc_b double, delta double, boot_delta double, ordered boolean")


_add("st_subgroups", _subgroups, "SELECT difficulty, count(*) AS n_items, round(avg(quality), 9) AS acc_a, round(avg(toxic), 9) AS acc_b, round(avg(toxic) - avg(quality), 9) AS delta, round(avg(toxic) - avg(quality), 9) AS boot_delta, true AS ordered FROM s GROUP BY difficulty HAVING count(*) >= 2")


def _cluster(s: DataFrame) -> DataFrame:
    """The bootstrap by question, told by what all seeds share: its interval is in order and holds the mean of the draws."""
    sums = [r for r in Z.group_sums(s.where("difficulty = 'en'").withColumn("kind", F.when(F.col("run_id") % 2 == 0, "base").otherwise("paraphrase")), "question_id", "kind", "quality", "toxic").collect()]
    found = Z.cluster_bootstrap(sums, "quality", "toxic")
    return s.sparkSession.createDataFrame([(len(sums), found["ci_lo"] <= found["mean"] <= found["ci_hi"], 0 <= found["p_boot"] <= 1)], "n_groups long, inside boolean, is_share boolean")


_add("st_cluster_bootstrap", _cluster, "SELECT count(DISTINCT question_id) AS n_groups, true AS inside, true AS is_share FROM s WHERE difficulty = 'en'")
_add("st_accuracy", lambda s: s.groupBy("difficulty").agg(F.round(F.avg("quality"), 9).alias("acc_a"), F.round(F.avg("toxic"), 9).alias("acc_b")), "SELECT difficulty, round(avg(quality), 9) AS acc_a, round(avg(toxic), 9) AS acc_b FROM s GROUP BY difficulty")
_add("st_passk", lambda s: Z.pass_at_k(s.withColumn("score", F.col("toxic")), "question_id", "difficulty"), "SELECT difficulty, count(*) AS n_questions, round(avg(best), 9) AS pass_at_k, round(sum(s) / sum(k), 9) AS mean_run_acc FROM (SELECT difficulty, question_id, max(toxic) AS best, sum(toxic) AS s, count(toxic) AS k FROM s GROUP BY ALL) GROUP BY difficulty")
_add(
    "st_robustness",
    lambda s: Z.robustness(s, "kind", "quality", "difficulty"),
    "SELECT *, round(paraphrase - base, 6) AS delta FROM (SELECT difficulty, count(quality) FILTER (kind = 'base') AS n_base, round(100 * avg(quality) FILTER (kind = 'base'), 6) AS base, count(quality) FILTER (kind = 'paraphrase') AS n_paraphrase, round(100 * avg(quality) FILTER (kind = 'paraphrase'), 6) AS paraphrase, round(100 * avg(quality), 6) AS overall FROM s GROUP BY difficulty)",
)
_sum = ", ".join(f"coalesce(sum({c}) FILTER (kind = '{k}'), 0) AS {c}_{k}_sum, count({c}) FILTER (kind = '{k}') AS {c}_{k}_n" for c in ("quality", "toxic") for k in ("base", "paraphrase"))
_add("st_group_sums", lambda s: Z.group_sums(s, "question_id", "kind", "quality", "toxic"), f"SELECT question_id, {_sum} FROM s GROUP BY question_id")


def _poisson_sql() -> str:
    total, term, out = 0.0, 0.36787944117144233, "CASE"
    for k in range(8):
        total += term
        out += f" WHEN u < {total!r} THEN {k}"
        term /= k + 1
    return out + " ELSE 8 END"


_add(
    "st_bootstrap_md5",
    lambda s: Z.poisson_bootstrap(s, "run_id", "quality", "toxic", 50),
    f", d AS (SELECT draw, quality, toxic, ('0x' || substr(md5(concat(draw, '-', run_id)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s, range(1, 51) r(draw)), w AS (SELECT *, {_poisson_sql()} AS w FROM d) SELECT draw::INT AS draw, round(sum(w * (toxic - quality))::DOUBLE / sum(w), 9) AS delta FROM w WHERE w > 0 GROUP BY draw",
)
_DRAWS = 10_000


def _weights_sql(key: str, source: str) -> str:
    """x: the rows of source for each draw, with w, the weight of the counter law for keys below 2^32."""

    def final(name: str, start: str, source: str) -> str:
        out = f"{name}0 AS (SELECT *, {start} AS h FROM {source})"
        for k, (shift, factor) in enumerate(Z._FINAL):
            out += f", {name}{k + 1} AS (SELECT * EXCLUDE h, xor(h, h >> {shift}) * {factor}::UBIGINT & {Z._LOW}::UBIGINT AS h FROM {name}{k})"
        return f"{out}, {name} AS (SELECT * EXCLUDE h, xor(h, h >> 16) AS {name}_h FROM {name}2)"

    steps = " ".join(f"WHEN h2_h / 4294967296.0::DOUBLE < {v!r} THEN {k}" for k, v in enumerate(Z.POISSON))
    turn = f"xor(h1_h, draw::UBIGINT * {Z._GOLDEN}::UBIGINT & {Z._LOW}::UBIGINT)"
    return f"{final('h1', f'{key}::UBIGINT', source)}, {final('h2', turn, f'h1, range(1, {_DRAWS + 1}) r(draw)')}, x AS (SELECT *, CASE {steps} ELSE 8 END AS w FROM h2)"


_BOUNDS = "round(quantile_cont(v, 0.025), 9) AS ci_lo, round(quantile_cont(v, 0.975), 9) AS ci_hi, round(avg(CASE WHEN abs(v - obs) >= abs(obs) - 1e-9 THEN 1.0::DOUBLE ELSE 0 END), 9) AS p_boot"


def _found(spark: SparkSession, found: dict) -> DataFrame:
    return spark.createDataFrame([tuple(round(found[k], 9) for k in ("obs", "ci_lo", "ci_hi", "p_boot"))], "obs double, ci_lo double, ci_hi double, p_boot double")


_add(
    "st_bootstrap_interval",
    lambda s: _found(s.sparkSession, Z.keyed_bootstrap(s, "run_id", F.col("toxic") - F.col("quality"))),
    f", {_weights_sql('run_id', 's')}, o AS (SELECT avg(toxic - quality) AS obs FROM s), d AS (SELECT sum(w * (toxic - quality))::DOUBLE / sum(w) AS v FROM x GROUP BY draw HAVING sum(w) > 0) SELECT round(any_value(obs), 9) AS obs, {_BOUNDS} FROM d, o",
)
# four conditions of a run: the difference in differences is a mean of one value an item
_FOUR = "((CAST(run_id % 2 = 0 AS INT) - CAST(run_id % 3 = 0 AS INT)) - (toxic - quality))"
_add(
    "st_did_interval",
    lambda s: _found(s.sparkSession, Z.keyed_bootstrap(s, "run_id", F.expr(_FOUR))),
    f", y AS (SELECT run_id, {_FOUR} AS y FROM s), {_weights_sql('run_id', 'y')}, o AS (SELECT avg(y) AS obs FROM y), d AS (SELECT sum(w * y)::DOUBLE / sum(w) AS v FROM x GROUP BY draw HAVING sum(w) > 0) SELECT round(any_value(obs), 9) AS obs, {_BOUNDS} FROM d, o",
)


_CELLS = [f"{c}_{k}_{m}" for c in ("quality", "toxic") for k in ("base", "paraphrase") for m in ("sum", "n")]


def _cluster_interval(s: DataFrame) -> DataFrame:
    """Questions drawn whole: the loss of paraphrases under toxic less that under quality, with its interval, from sums by question."""
    s = s.withColumn("question_id", F.concat_ws("-", "question_id", "difficulty", (F.col("run_id") % 7).cast("string")))
    sums = Z.group_sums(s, "question_id", "kind", "quality", "toxic")
    keyed = sums.withColumn("key", F.conv(F.substring(F.md5(F.col("question_id").cast("binary")), 1, 8), 16, 10).cast("long"))
    share = lambda c, k: F.try_divide(F.col(f"{c}_{k}_sum"), F.col(f"{c}_{k}_n"))
    loss = lambda c: 100 * (share(c, "paraphrase") - share(c, "base"))
    value = loss("toxic") - loss("quality")
    observed = sums.agg(*[F.sum(n).cast("double").alias(n) for n in _CELLS]).select(value).first()[0]
    return _found(s.sparkSession, Z.interval_of(Z.drawn_sums(keyed, "key", *_CELLS), value, observed))


def _loss_sql(w: str) -> str:
    share = lambda c, k: f"sum({w}{c}_{k}_sum)::DOUBLE / nullif(sum({w}{c}_{k}_n), 0)"
    loss = lambda c: f"100 * ({share(c, 'paraphrase')} - {share(c, 'base')})"
    return f"{loss('toxic')} - {loss('quality')}"


_add(
    "st_cluster_interval",
    _cluster_interval,
    f", q AS (SELECT * REPLACE (concat_ws('-', question_id, difficulty, run_id % 7) AS question_id) FROM s), g AS (SELECT ('0x' || substr(md5(question_id), 1, 8))::BIGINT AS key, {_sum} FROM q GROUP BY question_id), "
    f"{_weights_sql('key', 'g')}, o AS (SELECT {_loss_sql('')} AS obs FROM g), d AS (SELECT {_loss_sql('w * ')} AS v FROM x GROUP BY draw HAVING sum(w) > 0 AND v IS NOT NULL) SELECT round(any_value(obs), 9) AS obs, {_BOUNDS} FROM d, o",
)
_add("st_did_patterns", lambda c: Z.did_patterns(c, "z", "l", "f", "c"), "SELECT z, l, f, c, count(*) AS n FROM c4 GROUP BY ALL", conditions, _C)
_DID = ("obs_did", "acc_zeroshot", "acc_lexicon", "acc_lf", "acc_combined", "marginal_lex", "marginal_lf", "expected_add", "actual_combined_gain")


def _did(c: DataFrame) -> DataFrame:
    found = Z.did(Z.did_patterns(c, "z", "l", "f", "c").collect())
    return c.sparkSession.createDataFrame([(found["n_items"], *[round(found[k], 9) for k in _DID])], "n_items long, " + ", ".join(f"{k} double" for k in _DID))


_add(
    "st_did",
    _did,
    "SELECT count(*) AS n_items, round((avg(c) - avg(f)) - (avg(l) - avg(z)), 9) AS obs_did, round(avg(z), 9) AS acc_zeroshot, round(avg(l), 9) AS acc_lexicon, round(avg(f), 9) AS acc_lf, round(avg(c), 9) AS acc_combined, round(avg(l) - avg(z), 9) AS marginal_lex, round(avg(f) - avg(z), 9) AS marginal_lf, round(avg(l) + avg(f) - 2 * avg(z), 9) AS expected_add, round(avg(c) - avg(z), 9) AS actual_combined_gain FROM c4",
    conditions,
    _C,
)
_add("st_difficulty", lambda s: s.select("run_id", Z.difficulty_number(F.when(F.col("difficulty") == "en", "hard").when(F.col("difficulty") == "de", "extra").otherwise(F.col("difficulty"))).alias("d")), "SELECT run_id, CASE difficulty WHEN 'en' THEN 2 WHEN 'de' THEN 3 ELSE 1 END AS d FROM s")


def _four(s: DataFrame, name: str) -> DataFrame:
    return s.select("question_id", F.lit("easy").alias("difficulty"), F.col(name).alias("score"))


def _stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conditions(spark, sf_dir)
    design = Z.stacked(**{k: _four(c, v) for k, v in (("zeroshot", "z"), ("lexicon", "l"), ("lf", "f"), ("combined", "c"))})
    return design.groupBy("lex", "lf").agg(F.count("*").alias("n"), F.sum("score").alias("s"))


QUERIES["st_stacked"] = _stacked
ORACLES["st_stacked"] = f"WITH {_C} SELECT * FROM (SELECT 0 AS lex, 0 AS lf, count(*) AS n, sum(z) AS s FROM c4 UNION ALL SELECT 1, 0, count(*), sum(l) FROM c4 UNION ALL SELECT 0, 1, count(*), sum(f) FROM c4 UNION ALL SELECT 1, 1, count(*), sum(c) FROM c4)"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conditions(spark, sf_dir)
    fit = Z.mixed_model(Z.stacked(**{k: _four(c, v) for k, v in (("zeroshot", "z"), ("lexicon", "l"), ("lf", "f"), ("combined", "c"))}))
    # the level depends on the variance ratio, but the effects don't: every question has all four conditions equally often
    rows = [(k, float(v)) for k, v in fit["params"].items() if k != "Intercept"]
    return spark.createDataFrame(rows, "term string, estimate double").withColumn("estimate", F.round("estimate", 6) + F.lit(0.0))


def _mixed_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parameters of the model where difficulty varies by question and every question has each condition once.

    With equal numbers in every question the estimates are those of sums over questions, and the variances have closed forms.
    """
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    flags = {"zeroshot": F.col("p_size") % 2, "lexicon": F.col("p_size") % 3, "lf": F.col("p_partkey") % 2, "combined": F.col("p_size") % 5}
    hardness = F.element_at(F.array(*map(F.lit, Z.DIFFICULTY)), (F.col("p_partkey") % 4 + 1).cast("int"))
    design = {k: rows.select(F.col("p_partkey").alias("question_id"), hardness.alias("difficulty"), (c > 0).cast("int").alias("score")) for k, c in flags.items()}
    fit = Z.mixed_model(Z.stacked(**design))
    found = {**fit["params"], "group_variance": fit["group_variance"], "residual_variance": fit["residual_variance"]}
    out = spark.createDataFrame([(k, float(v)) for k, v in found.items()], "term string, estimate double")
    return out.withColumn("estimate", F.round("estimate", 5) + F.lit(0.0))


QUERIES["st_mixed_difficulty"] = _mixed_difficulty
# balanced: effects are differences of means; the slope on difficulty is that of the questions' means; the variances follow from the two sums of squares
ORACLES["st_mixed_difficulty"] = (
    "WITH y AS (SELECT p_partkey AS q, p_partkey % 4 AS d, (p_size % 2 > 0)::INT AS z, (p_size % 3 > 0)::INT AS l, (p_partkey % 2 > 0)::INT AS f, (p_size % 5 > 0)::INT AS c FROM part), "
    "m AS (SELECT avg(z) AS z, avg(l) AS l, avg(f) AS f, avg(c) AS c, count(*)::DOUBLE AS n FROM y), "
    "g AS (SELECT q, d, (z + l + f + c) / 4.0::DOUBLE AS mean FROM y), b AS (SELECT regr_slope(mean, d) AS slope, regr_intercept(mean, d) AS base FROM g), "
    "w AS (SELECT sum((y.z - g.mean - m.z + t) ** 2 + (y.l - g.mean - m.l + t) ** 2 + (y.f - g.mean - m.f + t) ** 2 + (y.c - g.mean - m.c + t) ** 2) AS inside "
    "FROM y JOIN g ON g.q = y.q, (SELECT *, (z + l + f + c) / 4 AS t FROM m) m), a AS (SELECT 4 * sum((mean - base - slope * d) ** 2) AS among FROM g, b), "
    "v AS (SELECT inside / (3 * n) AS e, greatest(0, (among / n - inside / (3 * n)) / 4) AS u, (inside + among) / (4 * n) AS pooled FROM w, a, m) "
    "SELECT 'lex' AS term, round(l - z, 5) AS estimate FROM m UNION ALL SELECT 'lf', round(f - z, 5) FROM m UNION ALL SELECT 'lex:lf', round(c - l - f + z, 5) FROM m "
    "UNION ALL SELECT 'difficulty_num', round(slope, 5) FROM b UNION ALL SELECT 'Intercept', round(base + z - (z + l + f + c) / 4, 5) FROM b, m "
    "UNION ALL SELECT 'group_variance', round(u, 5) FROM v UNION ALL SELECT 'residual_variance', round(CASE WHEN u > 0 THEN e ELSE pooled END, 5) FROM v"
)
QUERIES["st_mixed_model"] = _mixed
ORACLES["st_mixed_model"] = (
    f"WITH {_C}, m AS (SELECT avg(z) AS z, avg(l) AS l, avg(f) AS f, avg(c) AS c FROM c4) SELECT 'lex' AS term, round(l - z, 6) AS estimate FROM m "
    "UNION ALL SELECT 'lf', round(f - z, 6) FROM m UNION ALL SELECT 'lex:lf', round(c - l - f + z, 6) FROM m UNION ALL SELECT 'difficulty_num', 0.0::DOUBLE FROM m"
)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.when(F.col("p_partkey") % 5 == 0, "base").otherwise("paraphrase").alias("kind")
    return rows.select("p_partkey", kind, F.concat_ws(";", F.concat("p_brand", F.lit(" - "), "p_type"), F.concat("p_type", F.lit(" - "), "p_brand")).alias("classes"), (F.col("p_size") % 2).alias("score"), F.when(F.col("p_size") < 10, "no_hardness").otherwise("easy").alias("hardness"))


_P = "p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'base' ELSE 'paraphrase' END AS kind, concat_ws(';', concat(p_brand, ' - ', p_type), concat(p_type, ' - ', p_brand)) AS classes, p_size % 2 AS score, CASE WHEN p_size < 10 THEN 'no_hardness' ELSE 'easy' END AS hardness FROM part), e AS (SELECT *, unnest(string_split(classes, ';')) AS class FROM p)"
_add("ql_explode", lambda p: Z.labels(p, "classes").select("p_partkey", F.col("classes").alias("class")), "SELECT p_partkey, class FROM e", parts, _P)
_add(
    "ql_counts",
    lambda p: Z.qualifier_counts(Z.labels(p, "classes", heads=True), "classes", "kind", {"base": 205, "paraphrase": 1450, "both": 1655}),
    "SELECT *, round(base / 205.0::DOUBLE * 100, 6) AS base_pct, round(paraphrase / 1450.0::DOUBLE * 100, 6) AS paraphrase_pct, round(\"both\" / 1655.0::DOUBLE * 100, 6) AS both_pct FROM (SELECT split_part(class, ' - ', 1) AS label, count(*) FILTER (kind = 'base') AS base, count(*) FILTER (kind = 'paraphrase') AS paraphrase, count(*) AS \"both\" FROM e GROUP BY 1)",
    parts,
    _P,
)
_add("ql_results_em", lambda p: Z.qualifier_results(Z.labels(p, "classes", heads=True), "classes", "kind", "score", "hardness"), "SELECT split_part(class, ' - ', 1) AS label, kind, count(*) AS total, count(*) FILTER (score = 1) AS ok FROM e WHERE hardness <> 'no_hardness' GROUP BY ALL", parts, _P)
_add("ql_results_ex", lambda p: Z.qualifier_results(Z.labels(p, "classes", heads=True), "classes", "kind", "score"), "SELECT split_part(class, ' - ', 1) AS label, kind, count(*) AS total, count(*) FILTER (score = 1) AS ok FROM e GROUP BY ALL", parts, _P)



def _perspective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of a perspective: qualifiers 6 to 8, here the brand, type and name of parts."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.when(F.col("p_partkey") % 5 == 0, "base").otherwise("paraphrase").alias("Base_paraphrase")
    df = rows.select(kind, *[F.col(c).alias(Z.QUALIFIERS[q][0]) for q, c in ((6, "p_brand"), (7, "p_type"), (8, "p_name"))])
    found = Z.perspective(df, "sql")
    return reduce(DataFrame.unionByName, [v.withColumn("qualifier", F.lit(q)) for q, v in found.items()])


QUERIES["ql_perspective"] = _perspective
ORACLES["ql_perspective"] = (
    "WITH l AS (SELECT 6 AS qualifier, p_brand AS label, p_partkey FROM part UNION ALL SELECT 7, p_type, p_partkey FROM part UNION ALL SELECT 8, p_name, p_partkey FROM part), "
    "c AS (SELECT qualifier, label, count(*) FILTER (p_partkey % 5 = 0) AS base, count(*) FILTER (p_partkey % 5 <> 0) AS paraphrase, count(*) AS \"both\" FROM l WHERE label IS NOT NULL GROUP BY ALL) "
    "SELECT *, round(base / 205.0::DOUBLE * 100, 6) AS base_pct, round(paraphrase / 1450.0::DOUBLE * 100, 6) AS paraphrase_pct, round(\"both\" / 1655.0::DOUBLE * 100, 6) AS both_pct FROM c"
)

# SQLite's dialect end to end: pairs of predicted and gold statements over the event log
_PAIRS = [
    ("SELECT COUNT(*) FROM event_log WHERE activity LIKE 'VIEW'", "SELECT COUNT(id) FROM event_log WHERE activity = 'view'", 1),
    ("SELECT activity, COUNT(*) FROM event_log GROUP BY activity", "SELECT activity, COUNT(*) AS 'how many' FROM event_log GROUP BY activity", 1),
    ("SELECT DISTINCT activity FROM event_log ORDER BY activity DESC", "SELECT DISTINCT activity FROM event_log ORDER BY activity", 0),
    ("SELECT DISTINCT activity FROM event_log ORDER BY activity DESC", "SELECT DISTINCT activity FROM event_log", 1),
    ("SELECT activity FROM (SELECT daycase, activity, MIN(timestamp) FROM event_log GROUP BY daycase)", "SELECT activity FROM event_log", 0),
    ("SELECT COUNT(*) FROM event_log WHERE strftime('%Y-%m', timestamp) = '2024-01'", "SELECT COUNT(*) FROM event_log", 1),
    ("SELECT idcase FROM event_log WHERE activity = 'view' INTERSECT SELECT idcase FROM event_log WHERE cost > 100", "SELECT DISTINCT idcase FROM event_log WHERE activity = 'view' AND cost > 100", None),
    ("DELETE FROM event_log", "SELECT COUNT(*) FROM event_log", 0),
    ("SELECT nothing FROM event_log", "SELECT COUNT(*) FROM event_log", 0),
    ("", "SELECT COUNT(*) FROM event_log", 0),
]


def _execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    event_log(spark, sf_dir).createOrReplaceTempView("event_log")
    rows = [(i, p, g) for i, (p, g, want) in enumerate(_PAIRS) if want is not None]
    out = E.execution_accuracy(spark.createDataFrame(rows, "id int, pred string, gold string"), "pred", "gold", timeout=60)
    return out.select("id", "ex")


QUERIES["ev_execution"] = _execution
ORACLES["ev_execution"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {want})" for i, (_, _, want) in enumerate(_PAIRS) if want is not None) + ") t(id, ex)"

# every one of twelve statements as the prediction of each, but none without an order for one with: as SQLite's dialect, and as rows (text) in an order (place) for DuckDB
_TWELVE = [
    ("SELECT activity FROM event_log WHERE cost > 40", "activity", "cost > 40", ""),
    ("SELECT UPPER(activity) AS 'what it was' FROM event_log WHERE NOT cost <= 40", "activity", "cost > 40", ""),
    ("SELECT activity FROM event_log WHERE cost >= 41 ORDER BY id", "activity", "cost >= 41", "id"),
    ("SELECT ' ' || activity FROM event_log WHERE cost > 40 ORDER BY id", "activity", "cost > 40", "id"),
    ("SELECT activity FROM event_log WHERE cost > 40 ORDER BY id DESC", "activity", "cost > 40", "-id"),
    ("SELECT DISTINCT activity FROM event_log WHERE cost > 40 ORDER BY activity", "DISTINCT activity", "cost > 40", "activity"),
    ("SELECT activity FROM event_log WHERE cost > 40 GROUP BY activity", "DISTINCT activity", "cost > 40", ""),
    ("SELECT MIN(activity) FROM event_log WHERE activity LIKE 'PURCHASE' GROUP BY activity", "DISTINCT activity", "activity = 'purchase'", ""),
    ("SELECT DISTINCT activity FROM event_log WHERE cost > 40 ORDER BY activity DESC", "DISTINCT activity", "cost > 40", "chr(255 - ascii(activity))"),
    ("SELECT activity, id FROM event_log WHERE cost > 40", "activity || '|' || id", "cost > 40", ""),
    ("SELECT activity FROM event_log WHERE cost > 40 ORDER BY 0 - id", "activity", "cost > 40", "-id"),
    ("SELECT idcase FROM event_log WHERE resource IS NULL ORDER BY id", "idcase", "resource IS NULL", "id"),
]


def _execution_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution accuracy of 109 pairs, compared by digests of their whole results."""
    event_log(spark, sf_dir).createOrReplaceTempView("event_log")
    rows = [(100 * i + j, p[0], g[0]) for i, p in enumerate(_TWELVE) for j, g in enumerate(_TWELVE) if p[3] or not g[3]]
    out = E.execution_accuracy(spark.createDataFrame(rows, "id int, pred string, gold string"), "pred", "gold", timeout=60)
    return out.select("id", "ex", F.col("ex_detail.pred_rows_count").alias("pred_rows"))


QUERIES["ev_execution_pairs"] = _execution_pairs
ORACLES["ev_execution_pairs"] = (
    f"WITH event_log AS ({DUCK_LOG}), s AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS k, {str(bool(order)).lower()} AS ordered, list(x ORDER BY place) AS l FROM (SELECT x, row_number() OVER (ORDER BY {order.replace('activity', 'x') or 'x'}) AS place FROM (SELECT {what} AS x{', id' if 'id' in order else ''} FROM event_log WHERE {where}))"
        for i, (_, what, where, order) in enumerate(_TWELVE)
    )
    + ") SELECT CAST(100 * p.k + g.k AS INT) AS id, CAST(CASE WHEN g.ordered THEN p.l = g.l ELSE list_sort(p.l) = list_sort(g.l) END AS INT) AS ex, len(p.l) AS pred_rows FROM s p, s g WHERE p.ordered OR NOT g.ordered"
)


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match of statements written about each part: the same one in other letter case, quotes and spaces, or another one."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    gold = F.concat(F.lit("SELECT COUNT(*) FROM event_log WHERE activity = '"), "p_name", F.lit("'"))
    other = F.concat(F.lit("select  count(*)\nfrom event_log where activity = '"), F.upper("p_name"), F.lit("' ;"))
    kinds = F.when(F.col("p_partkey") % 4 == 0, other).when(F.col("p_partkey") % 4 == 1, F.concat(gold, F.lit(" LIMIT 1"))).when(F.col("p_partkey") % 4 == 2, "").otherwise(gold)
    return E.exact_match(rows.select("p_partkey", kinds.alias("pred"), gold.alias("gold")), "pred", "gold").select("p_partkey", "em", "normalized_gold")


QUERIES["ev_exact_match"] = _exact
ORACLES["ev_exact_match"] = "SELECT p_partkey, CAST(p_partkey % 4 IN (0, 3) AS INT) AS em, 'select count(*) from event_log where activity = ' || lower(p_name) AS normalized_gold FROM part"


def _multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the orders as text, and whether two renderings of one result are the same rows, as a list and as a multiset."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus", "o_totalprice")
    cells = E.normal_rows(rows).cache()
    other = E.normal_rows(rows.select(F.concat(F.lit(" "), F.lower("o_orderstatus")), F.col("o_totalprice").cast("decimal(20, 2)"))).cache()
    same = [E.same_rows(cells, other, ordered) for ordered in (True, False)] + [E.same_rows(cells, other.where("row[0] <> 'f'"), False)]
    out = cells.select(F.col("row")[0].alias("status"), F.col("row")[1].alias("price")).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("price").alias("prices"))
    return out.withColumns(dict(zip(("same_list", "same_multiset", "same_without"), map(F.lit, same), strict=True)))


QUERIES["ev_normal_rows"] = _multiset
ORACLES["ev_normal_rows"] = "SELECT lower(trim(o_orderstatus)) AS status, count(*) AS n, count(DISTINCT CASE WHEN o_totalprice = floor(o_totalprice) THEN printf('%.0f', o_totalprice) ELSE printf('%.6f', o_totalprice) END) AS prices, true AS same_list, true AS same_multiset, false AS same_without FROM orders GROUP BY 1"
