"""Paired statistics over scored runs. Spark reduces to a few cells or sums; the driver finishes in closed form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA, DRAWS, SEED = 0.05, 10_000, 0
# Difficulty as a number; unknown ones are 1.
DIFFICULTY = {"easy": 0, "medium": 1, "hard": 2, "extra": 3, "no_hardness": 1}


def paired(*runs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Runs (run_id, score) side by side on the ids that all have."""
    out = runs[0].select("run_id", F.col("score").alias(names[0]))
    for run, name in zip(runs[1:], names[1:], strict=True):
        out = out.join(run.select("run_id", F.col("score").alias(name)), "run_id")
    return out


def contingency(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """The 2 x 2 cells a (both right), b (first only), c (second only), d (neither), n, by groups if any."""
    x, y = F.col(a) == 1, F.col(b) == 1
    cells = [F.count_if(c).alias(k) for k, c in (("a", x & y), ("b", x & ~y), ("c", ~x & y), ("d", ~x & ~y))]
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(*cells, F.count("*").alias("n"))


def mcnemar(a: int, b: int, c: int, d: int, alpha: float = ALPHA) -> dict:
    """McNemar's test of two paired binary scores from their cells.

    Exact and two-sided below 25 discordant pairs, else chi-squared with continuity correction.
    """
    n, nd = a + b + c + d, b + c
    if nd == 0:
        p, stat, method = 1.0, 0.0, "exact (no discordant pairs)"
    elif nd < 25:
        tail = sum(math.comb(nd, i) for i in range(min(b, c) + 1)) / 2**nd
        p, stat, method = min(1.0, 2 * tail), None, "exact binomial McNemar"
    else:
        stat = (abs(b - c) - 1) ** 2 / nd
        p, method = math.erfc(math.sqrt(stat / 2)), "chi-squared with continuity correction"
    acc = lambda k: k / n if n else None
    delta = (c - b) / n if n else None
    return {"n_items": n, "a": a, "b": b, "c": c, "d": d, "n_discordant": nd, "statistic": stat, "p_value": p, "significant": p < alpha, "method": method, "acc_A": acc(a + b), "acc_B": acc(a + c), "delta": delta}


def _interval(draws: np.ndarray, observed: float, alpha: float, slack: float = 0.0) -> dict:
    """slack: how far two sides of the p-value's comparison may be apart and count as equal."""
    lo, hi = (float(np.percentile(draws, 100 * q)) for q in (alpha / 2, 1 - alpha / 2))
    p = float(np.mean(np.abs(draws - observed) >= abs(observed) - slack))
    return {"ci_lo": lo, "ci_hi": hi, "ci_level": f"{int((1 - alpha) * 100)}%", "p_boot": p, "significant": lo > 0 or hi < 0}


def bootstrap_patterns(counts: np.ndarray, values: np.ndarray, draws: int = DRAWS, alpha: float = ALPHA, seed: int = SEED) -> dict:
    """Percentile bootstrap of a mean over items that take one of a few values.

    Resampling n items is a multinomial draw of pattern counts: exact in distribution, at a cost that
    doesn't depend on n. (Two conditions have 4 patterns, four have 16.)
    """
    counts, values = np.asarray(counts, dtype=np.int64), np.asarray(values, dtype=float)
    n = int(counts.sum())
    observed = float(counts @ values / n)
    drawn = np.random.default_rng(seed).multinomial(n, counts / n, size=draws) @ values / n
    return {"obs": observed, **_interval(drawn, observed, alpha)}


def paired_bootstrap(a: int, b: int, c: int, d: int, **kw) -> dict:
    """The bootstrap of acc(B) - acc(A) from the cells of contingency()."""
    out = bootstrap_patterns(np.array([a, b, c, d]), np.array([0, -1, 1, 0]), **kw)
    return {"obs_delta": out.pop("obs"), **out}


def paired_bootstrap_exact(first: np.ndarray, second: np.ndarray, draws: int = DRAWS, alpha: float = ALPHA, seed: int = SEED) -> dict:
    """The same on collected vectors with index draws of NumPy's default generator, for published figures."""
    rng, diff = np.random.default_rng(seed), np.asarray(second, float) - np.asarray(first, float)
    found = np.array([diff[rng.integers(0, len(diff), size=len(diff))].mean() for _ in range(draws)])
    return {"obs_delta": float(diff.mean()), **_interval(found, float(diff.mean()), alpha)}


def did_patterns(pairs: DataFrame, z: str, l: str, f: str, c: str) -> DataFrame:  # noqa: E741
    """Counts of the 16 patterns of four conditions."""
    return pairs.groupBy(*[F.col(x).cast("int").alias(k) for x, k in ((z, "z"), (l, "l"), (f, "f"), (c, "c"))]).agg(F.count("*").alias("n"))


def did(rows: list, **kw) -> dict:
    """Difference in differences [C - F] - [L - Z] with its bootstrap, from the rows of did_patterns()."""
    counts = np.array([r["n"] for r in rows])
    cols = {k: np.array([r[k] for r in rows], dtype=float) for k in "zlfc"}
    n = counts.sum()
    acc = {k: float(counts @ v / n) for k, v in cols.items()}
    out = bootstrap_patterns(counts, (cols["c"] - cols["f"]) - (cols["l"] - cols["z"]), **kw)
    return {
        "n_items": int(n), "obs_did": out.pop("obs"), **out, "acc_zeroshot": acc["z"], "acc_lexicon": acc["l"], "acc_lf": acc["f"], "acc_combined": acc["c"],
        "marginal_lex": acc["l"] - acc["z"], "marginal_lf": acc["f"] - acc["z"], "expected_add": acc["l"] + acc["f"] - 2 * acc["z"], "actual_combined_gain": acc["c"] - acc["z"],
    }


def subgroups(pairs: DataFrame, a: str, b: str, by: str, **kw) -> dict:
    """McNemar and bootstrap of each subgroup with two items or more."""
    rows = contingency(pairs, a, b, by).where("n >= 2").collect()
    out = {}
    for r in sorted(rows, key=lambda r: str(r[by])):
        cells = (r["a"], r["b"], r["c"], r["d"])
        out[r[by]] = {**mcnemar(*cells), **{f"boot_{k}": v for k, v in paired_bootstrap(*cells, **kw).items()}}
    return out


def poisson_weight(*key: Column) -> Column:
    """A Poisson(1) number of a key, from its md5: how often an item is drawn, without numbering the items.

    Weights of items are independent, so a bootstrap is one partial aggregate by draw at any size.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("-", *key).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out, total, term = None, 0.0, math.exp(-1)
    for k in range(8):
        total += term
        out = F.when(u < total, k) if out is None else out.when(u < total, k)
        term /= k + 1
    return out.otherwise(8)


def poisson_bootstrap(pairs: DataFrame, key: str, a: str, b: str, draws: int) -> DataFrame:
    """draw, delta: the weighted mean of b - a for each draw."""
    each = pairs.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    w = poisson_weight(F.col("draw").cast("string"), F.col(key).cast("string"))
    each = each.withColumn("w", w).where("w > 0")
    return each.groupBy("draw").agg(F.round(F.sum(F.col("w") * (F.col(b) - F.col(a))) / F.sum("w"), 9).alias("delta"))


# The shifts and multipliers of the 32-bit finaliser by which draws are made; any other engine can repeat them.
_FINAL = ((16, 0x85EBCA6B), (13, 0xC2B2AE35))
_GOLDEN, _LOW = 0x9E3779B9, (1 << 32) - 1


def _final(x: np.ndarray) -> np.ndarray:
    for shift, factor in _FINAL:
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(_LOW)
    return x ^ (x >> np.uint64(16))


def counter_weights(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Poisson(1) numbers, a row for each draw and a column for each whole-number key, that depend on (key, draw) alone."""
    keys = keys.astype(np.int64).view(np.uint64)
    keys = _final((keys & np.uint64(_LOW)) ^ _final(keys >> np.uint64(32)))
    turns = draws.astype(np.uint64) * np.uint64(_GOLDEN) & np.uint64(_LOW)
    u = _final(keys[None, :] ^ turns[:, None]) / float(1 << 32)
    return np.searchsorted(np.array(POISSON), u, side="right").astype(np.float64)


def _poisson_steps() -> list[float]:
    total, term, out = 0.0, math.exp(-1), []
    for k in range(8):
        total += term
        out.append(total)
        term /= k + 1
    return out


#: P(weight <= k) for k from 0 to 7.
POISSON = _poisson_steps()


def drawn_sums(rows: DataFrame, key: str, *values: str, draws: int = DRAWS) -> DataFrame:
    """draw (from 1), weight, and a weighted sum of each value: what a bootstrap of any ratio of sums needs.

    Each task adds up vectors over the draws; nothing has a row for an item and a draw. Items with a null key or value are
    left out; items of one key are drawn together.
    """
    step, names = 256, [f"s{i}" for i in range(len(values))]
    frame = rows.select(F.col(key).cast("long").alias("key"), *[F.col(v).cast("double").alias(n) for v, n in zip(values, names, strict=True)]).na.drop()

    def summed(batches):
        sums = np.zeros((draws, len(values) + 1))
        for b in batches:
            for first in range(0, len(b), 4096):
                part = b.iloc[first : first + 4096]
                what = np.column_stack([np.ones(len(part)), *[part[n].to_numpy() for n in names]])
                for at in range(0, draws, step):
                    sums[at : at + step] += counter_weights(part["key"].to_numpy(), np.arange(at + 1, min(at + step, draws) + 1)) @ what
        yield pd.DataFrame({"draw": np.arange(1, draws + 1), "weight": sums[:, 0], **{n: sums[:, i + 1] for i, n in enumerate(names)}})

    schema = "draw int, weight double, " + ", ".join(f"{n} double" for n in names)
    parts = frame.mapInPandas(summed, schema)
    return parts.groupBy("draw").agg(F.sum("weight").alias("weight"), *[F.sum(n).alias(v) for n, v in zip(names, values, strict=True)])


def interval_of(drawn: DataFrame, statistic: Column, observed: float, alpha: float = ALPHA) -> dict:
    """Percentile interval and two-sided p of a statistic of drawn_sums(): a number for each draw comes to the driver. Draws without
    the statistic (nothing was drawn) are left out.
    """
    found = np.array([r[0] for r in drawn.where("weight > 0").select(statistic).collect() if r[0] is not None])
    return {"obs": observed, **_interval(found, observed, alpha, slack=1e-9)}


def keyed_bootstrap(rows: DataFrame, key: str, value: Column, draws: int = DRAWS, alpha: float = ALPHA) -> dict:
    """The bootstrap of a mean at any number of items, with draws that other engines can repeat."""
    rows = rows.select(key, value.cast("double").alias("value")).na.drop()
    drawn = drawn_sums(rows, key, "value", draws=draws)
    return interval_of(drawn, F.col("value") / F.col("weight"), rows.agg(F.avg("value")).first()[0], alpha)


def pass_at_k(scores: DataFrame, question: str, *by: str) -> DataFrame:
    """n_questions, pass_at_k (mean over questions of the best score), mean_run_acc."""
    each = scores.groupBy(*by, question).agg(F.max("score").alias("best"), F.sum("score").alias("s"), F.count("score").alias("k"))
    return each.groupBy(*by).agg(F.count("*").alias("n_questions"), F.round(F.avg("best"), 9).alias("pass_at_k"), F.round(F.sum("s") / F.sum("k"), 9).alias("mean_run_acc"))


def robustness(scores: DataFrame, kind: str, score: str, *by: str) -> DataFrame:
    """Base, paraphrase and overall accuracy in percent, and the paraphrases' loss."""
    mean = lambda c: F.round(100 * F.avg(c), 6)
    base, para = (F.when(F.col(kind) == k, F.col(score)) for k in ("base", "paraphrase"))
    out = scores.groupBy(*by).agg(F.count(base).alias("n_base"), mean(base).alias("base"), F.count(para).alias("n_paraphrase"), mean(para).alias("paraphrase"), mean(F.col(score)).alias("overall"))
    return out.withColumn("delta", F.round(F.col("paraphrase") - F.col("base"), 6))


def group_sums(scores: DataFrame, group: str, kind: str, *conditions: str) -> DataFrame:
    """Per group the sums and counts of base and paraphrase for each condition: all that the cluster bootstrap needs."""
    aggs = []
    for c in conditions:
        for k in ("base", "paraphrase"):
            v = F.when(F.col(kind) == k, F.col(c))
            aggs += [F.coalesce(F.sum(v), F.lit(0)).alias(f"{c}_{k}_sum"), F.count(v).alias(f"{c}_{k}_n")]
    return scores.groupBy(group).agg(*aggs)


def cluster_bootstrap(sums: list, first: str, second: str, draws: int = DRAWS, seed: int = 42) -> dict:
    """Groups drawn with replacement: the difference of degradations (paraphrase - base) of second and first.

    p is one-sided: the share of draws not above 0.
    """
    arrays = {k: np.array([r[k] for r in sums], dtype=float) for k in sums[0].asDict() if k.endswith(("_sum", "_n"))}
    rng, n = np.random.default_rng(seed), len(sums)

    def loss(w: np.ndarray, c: str) -> np.ndarray:
        share = lambda k: w @ arrays[f"{c}_{k}_sum"] / (w @ arrays[f"{c}_{k}_n"])
        return 100 * (share("paraphrase") - share("base"))

    found = np.empty(draws)
    step = max(1, (1 << 22) // n)  # draws at once: 32 MB of weights
    for at in range(0, draws, step):
        w = rng.multinomial(n, np.full(n, 1 / n), size=min(step, draws - at)).astype(float)
        found[at : at + step] = loss(w, second) - loss(w, first)
    return {"mean": float(found.mean()), "ci_lo": float(np.percentile(found, 2.5)), "ci_hi": float(np.percentile(found, 97.5)), "p_boot": float((found <= 0).mean())}


def difficulty_number(name: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in DIFFICULTY.items() for x in kv])[name], F.lit(1))


def stacked(**conditions: DataFrame) -> DataFrame:
    """The four conditions zeroshot, lexicon, lf and combined as one design with flags lex and lf."""
    flags = {"zeroshot": (0, 0), "lexicon": (1, 0), "lf": (0, 1), "combined": (1, 1)}
    parts = [df.select("question_id", "difficulty", "score", F.lit(flags[k][0]).alias("lex"), F.lit(flags[k][1]).alias("lf")) for k, df in conditions.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mixed_model(design: DataFrame) -> dict:
    """score ~ 1 + lex + lf + lex:lf + difficulty with a random intercept by question, maximum likelihood.

    Everything the likelihood needs is sums over groups, and groups of one size add up, so Spark hands over
    one row for each group size; the variance ratio is then found by golden section.
    """
    x = {"Intercept": F.lit(1.0), "lex": F.col("lex"), "lf": F.col("lf"), "lex:lf": F.col("lex") * F.col("lf"), "difficulty_num": difficulty_number(F.col("difficulty"))}
    names = list(x)
    rows = design.where("score is not null").select("question_id", *[c.cast("double").alias(f"x{i}") for i, c in enumerate(x.values())], F.col("score").cast("double").alias("y"))
    cols = [*[f"x{i}" for i in range(len(x))], "y"]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    group = rows.groupBy("question_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)], *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"q{i}_{j}") for i, j in pairs])
    sized = group.groupBy("n").agg(F.count("*").alias("k"), *[F.sum(f"q{i}_{j}").alias(f"q{i}_{j}") for i, j in pairs], *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"t{i}_{j}") for i, j in pairs]).collect()

    def full(r, letter):
        m = np.zeros((len(cols), len(cols)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"{letter}{i}_{j}"]
        return m

    sizes = [(r["n"], r["k"], full(r, "q"), full(r, "t")) for r in sized]
    n = sum(k * m for m, k, _, _ in sizes)

    def fit(theta: float):
        m = sum(q - theta / (1 + theta * size) * t for size, _, q, t in sizes)
        beta = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
        rss = max(1e-300, m[-1, -1] - beta @ m[:-1, -1])
        log_det = sum(k * math.log1p(theta * size) for size, k, _, _ in sizes)
        return -0.5 * (n * math.log(2 * math.pi * rss / n) + log_det + n), beta, rss / n, m[:-1, :-1]

    lo, hi, gold = -12.0, 8.0, (math.sqrt(5) - 1) / 2
    for _ in range(80):
        p, q = hi - gold * (hi - lo), lo + gold * (hi - lo)
        lo, hi = (lo, q) if fit(math.exp(p))[0] >= fit(math.exp(q))[0] else (p, hi)
    theta = max((0.0, math.exp((lo + hi) / 2)), key=lambda t: fit(t)[0])
    ll, beta, sigma2, info = fit(theta)
    se = np.sqrt(np.maximum(0, np.diag(np.linalg.pinv(info)) * sigma2))
    p = [math.erfc(abs(b / s) / math.sqrt(2)) if s else None for b, s in zip(beta, se, strict=True)]
    return {"n_obs": int(n), "n_questions": int(sum(k for _, k, _, _ in sizes)), "params": dict(zip(names, map(float, beta), strict=True)), "std_err": dict(zip(names, map(float, se), strict=True)), "pvalues": dict(zip(names, p, strict=True)), "group_variance": theta * sigma2, "residual_variance": sigma2, "log_likelihood": ll}


# --- qualifiers ---------------------------------------------------------------------------------


def labels(df: DataFrame, column: str, heads: bool = False) -> DataFrame:
    """A row for each label of a `;`-separated column; with heads the part before ` - `."""
    out = df.withColumn(column, F.explode(F.split(column, ";")))
    return out.withColumn(column, F.split_part(F.col(column), F.lit(" - "), F.lit(1))) if heads else out


def qualifier_counts(df: DataFrame, column: str, kind: str, totals: dict[str, int]) -> DataFrame:
    """label, counts of base, paraphrase and both, and their percentages of the fixed totals.

    After labels() a row may count under several labels, so percentages can pass 100 in sum.
    """
    base, para = F.count_if(F.col(kind) == "base"), F.count_if(F.col(kind) == "paraphrase")
    out = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(base.alias("base"), para.alias("paraphrase"), F.count("*").alias("both"))
    return out.select("*", *[F.round(F.col(k) / F.lit(float(t)) * 100, 6).alias(f"{k}_pct") for k, t in totals.items()])


def qualifier_results(df: DataFrame, column: str, kind: str, score: str, hardness: str | None = None) -> DataFrame:
    """label, kind, total, ok; with a hardness column (exact match) without `no_hardness`."""
    df = df if hardness is None else df.where(F.col(hardness) != "no_hardness")
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label"), F.col(kind).alias("kind")).agg(F.count("*").alias("total"), F.count_if(F.col(score) == 1).alias("ok"))


# Which qualifiers a perspective shows.
PERSPECTIVES = {"process_mining": (1, 2, 3, 4, 9), "sql": (6, 7, 8), "nlp": (5,)}
QUALIFIERS = {
    1: ("Events_cases_classification", False, False), 2: ("Purpose_classification", True, True), 3: ("Projection_classification", True, False),
    4: ("Condition_classification", True, False), 5: ("Wh_classification", True, False), 6: ("Projection_aggregation", False, False),
    7: ("Condition_group_classification", False, False), 8: ("Spider_classification", False, False), 9: ("Domain_value_generic", False, False),
}


def perspective(df: DataFrame, name: str, kind: str = "Base_paraphrase", totals: dict[str, int] | None = None) -> dict[int, DataFrame]:
    """The counts of each qualifier of a perspective."""
    totals = totals or {"base": 205, "paraphrase": 1450, "both": 1655}
    out = {}
    for q in PERSPECTIVES[name]:
        column, several, heads = QUALIFIERS[q]
        out[q] = qualifier_counts(labels(df, column, heads) if several else df, column, kind, totals)
    return out
