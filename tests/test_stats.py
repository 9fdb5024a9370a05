"""Statistics against published figures and against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import stats as Z


@pytest.mark.parametrize(
    ("a", "b", "c", "d", "stat", "p"),
    [
        (576, 100, 126, 853, 2.765487, 0.0963174),
        (576, 100, 175, 804, 19.912727, 8.10589e-06),
        (606, 96, 151, 802, 11.805668, 0.000590507),
        (639, 112, 118, 786, 0.108696, 0.741634),
        (40, 6, 8, 43, None, 0.79052734375),
        (10, 0, 0, 5, 0.0, 1.0),
    ],
)
def test_mcnemar_as_published(a, b, c, d, stat, p):
    out = Z.mcnemar(a, b, c, d)
    assert out["p_value"] == pytest.approx(p, rel=1e-5)
    assert out["statistic"] == (None if stat is None else pytest.approx(stat, abs=1e-6))
    assert out["a"] + out["b"] + out["c"] + out["d"] == out["n_items"]


def test_bootstrap_near_published():
    out = Z.paired_bootstrap(576, 100, 126, 853)
    assert out["obs_delta"] == pytest.approx(0.015710, abs=1e-6)
    assert out["ci_lo"] == pytest.approx(-0.001813, abs=0.002) and out["ci_hi"] == pytest.approx(0.033837, abs=0.002)
    assert out["p_boot"] == pytest.approx(0.0886, abs=0.02)


def test_exact_and_pattern_bootstraps_agree():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 2, 300), rng.integers(0, 2, 300)
    cells = [int(((x == i) & (y == j)).sum()) for i, j in ((1, 1), (1, 0), (0, 1), (0, 0))]
    exact, fast = Z.paired_bootstrap_exact(x, y, draws=4000), Z.paired_bootstrap(*cells, draws=4000)
    assert exact["obs_delta"] == pytest.approx(fast["obs_delta"])
    assert exact["ci_lo"] == pytest.approx(fast["ci_lo"], abs=0.02)


@pytest.fixture(scope="module")
def runs(spark):
    rng = np.random.default_rng(7)
    rows = [(f"{i // 4}_{i % 4}", ["easy", "hard", "odd"][i % 3], *map(int, rng.integers(0, 2, 4))) for i in range(60)]
    return spark.createDataFrame(rows, "run_id string, difficulty string, z int, l int, f int, c int")


def test_did(runs):
    out = Z.did(Z.did_patterns(runs, "z", "l", "f", "c").collect(), draws=500)
    m = runs.toPandas()[["z", "l", "f", "c"]].mean()
    assert out["obs_did"] == pytest.approx((m.c - m.f) - (m.l - m.z))
    assert out["ci_lo"] <= out["obs_did"] <= out["ci_hi"]


def test_pairing_needs_both_sides(spark, runs):
    one = runs.selectExpr("run_id", "z as score")
    other = runs.where("run_id <> '0_0'").selectExpr("run_id", "l as score")
    assert Z.paired(one, other, names=("a", "b")).count() == 59


def test_subgroups_skip_single_items(spark):
    df = spark.createDataFrame([("x", "easy", 1, 0), ("y", "easy", 0, 1), ("w", "alone", 1, 1)], "run_id string, difficulty string, a int, b int")
    assert set(Z.subgroups(df, "a", "b", "difficulty", draws=10)) == {"easy"}


def test_mixed_model_equals_least_squares_without_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(f"q{i}", "easy", float(rng.normal() + lex * 0.5), lex, lf) for i in range(80) for lex in (0, 1) for lf in (0, 1)]
    df = spark.createDataFrame(rows, "question_id string, difficulty string, score double, lex int, lf int")
    fit = Z.mixed_model(df)
    p = df.toPandas()
    x = np.c_[np.ones(len(p)), p.lex, p.lf, p.lex * p.lf]
    beta = np.linalg.lstsq(x, p.score, rcond=None)[0]
    assert [fit["params"][k] for k in ("Intercept", "lex", "lf", "lex:lf")] == pytest.approx(beta.tolist(), abs=1e-6)
    assert fit["n_obs"] == 320 and fit["n_questions"] == 80


def test_mixed_model_finds_group_variance(spark):
    rng = np.random.default_rng(4)
    effect = rng.normal(size=60) * 2
    rows = [(f"q{i}", "easy", float(effect[i] + rng.normal()), lex, lf) for i in range(60) for lex in (0, 1) for lf in (0, 1)]
    fit = Z.mixed_model(spark.createDataFrame(rows, "question_id string, difficulty string, score double, lex int, lf int"))
    assert 2 < fit["group_variance"] < 7 and 0.6 < fit["residual_variance"] < 1.5


def test_poisson_weights_have_mean_one(spark):
    from pyspark.sql import functions as F

    row = spark.range(5000).select(Z.poisson_weight(F.col("id").cast("string")).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert row[0] == pytest.approx(1, abs=0.06) and row[1] == pytest.approx(1, abs=0.1)


def test_cluster_bootstrap(spark):
    rows = [(g, k, s % 2, (s + g) % 2) for g in range(20) for s, k in enumerate(["base", "paraphrase", "paraphrase"])]
    sums = Z.group_sums(spark.createDataFrame(rows, "g int, kind string, lf int, comb int"), "g", "kind", "lf", "comb").collect()
    out = Z.cluster_bootstrap(sums, "lf", "comb", draws=300)
    assert out["ci_lo"] <= out["mean"] <= out["ci_hi"] and 0 <= out["p_boot"] <= 1


def test_qualifiers(spark):
    df = spark.createDataFrame([("a - x;b - y", "base", 1), ("b - z", "paraphrase", 0), (None, "base", 1)], "c string, kind string, score int")
    rows = {r["label"]: r for r in Z.qualifier_counts(Z.labels(df, "c", heads=True), "c", "kind", {"both": 2}).collect()}
    assert rows["b"]["both"] == 2 and rows["b"]["both_pct"] == 100.0 and rows["a"]["base"] == 1
    assert math.isclose(sum(r["both_pct"] for r in rows.values()), 150.0)


def test_draws_of_the_counter():
    w = Z.counter_weights(np.arange(2000), np.arange(1, 501))
    assert w.shape == (500, 2000) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.2
    assert abs(w.mean(axis=1).var() * 2000 - 1) < 0.2 and abs(w.mean(axis=0).var() * 500 - 1) < 0.2
    assert (Z.counter_weights(np.array([-5, 7]), np.array([3])) == Z.counter_weights(np.array([7, -5]), np.array([3]))[:, ::-1]).all()


def test_drawn_sums_dont_depend_on_partitions(spark):
    rows = spark.range(3000).selectExpr("id", "cast(id % 3 = 0 as int) as x", "if(id % 10 = 0, null, id % 7) as y")
    a, b = ({r["draw"]: r.asDict() for r in Z.drawn_sums(rows.repartition(n), "id", "x", "y", draws=40).collect()} for n in (1, 5))
    assert a == b and set(a) == set(range(1, 41))
    w = Z.counter_weights(np.array([i for i in range(3000) if i % 10]), np.array([7]))[0]
    assert a[7]["weight"] == w.sum() and a[7]["x"] == sum(k for i, k in zip((i for i in range(3000) if i % 10), w, strict=True) if i % 3 == 0)


def test_keyed_interval_is_that_of_drawing_items(spark):
    rows = spark.range(900).selectExpr("id", "cast(id % 3 = 0 as int) - cast(id % 5 = 0 as int) as v")
    found = Z.keyed_bootstrap(rows, "id", F.col("v"))
    values = np.array([(i % 3 == 0) * 1 - (i % 5 == 0) * 1 for i in range(900)])
    want = Z.paired_bootstrap_exact(np.zeros(900), values)
    assert found["obs"] == pytest.approx(want["obs_delta"]) and found["ci_lo"] == pytest.approx(want["ci_lo"], abs=0.004) and found["ci_hi"] == pytest.approx(want["ci_hi"], abs=0.004)
    assert found["p_boot"] == pytest.approx(want["p_boot"], abs=0.01)
