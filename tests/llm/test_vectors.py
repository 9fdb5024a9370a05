"""Hard negatives and vector codes against brute force over whole numbers of Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tracewright.llm import hardneg, queries, vectorcode
from tracewright.llm.common import Scratch

NAN, INF = float("nan"), float("inf")


def _kept(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def _long(x):
    return max(-(2**63 - 1), min(2**63 - 1, x))


def mined(rows, every, low=80, high=100, k=5):
    """By the definition, over all pairs of rows (id, label, vector)."""
    rows = [(i, lb, [math.floor(256 * x) for x in v]) for i, lb, v in rows if lb is not None and _kept(v)]
    order = lambda e: (-e[0], e[1] is None, e[1] or 0)
    out = []
    for n, (a, label, v) in enumerate(rows):
        if a is None or a % every:
            continue
        scores = [(_long(sum(x * y for x, y in zip(v, w, strict=False))), i, lb == label) for m, (i, lb, w) in enumerate(rows) if m != n]
        for p, positive, _ in sorted((s for s in scores if s[2]), key=order)[:k]:
            fit = sorted((s for s in scores if not s[2] and low * p <= 100 * s[0] <= high * p), key=order)[:k]
            out += [(a, positive, r, i, p, s) for r, (s, i, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def random_rows(n, width, values, labels, seed):
    random.seed(seed)
    return [(i, random.choice(labels), [random.choice(values) for _ in range(width)]) for i in range(n)]


ODD = [
    (0, 1, None),
    (5, None, [1.0, 2.0, 3.0]),
    (10, 1, [1.0, None, 2.0]),
    (15, 1, [NAN, 0.0, 1.0]),
    (20, 2, [INF, 0.0, 1.0]),
    (25, 2, []),
    (30, 1, [0.5]),
    (35, 1, [1.0, 1.0, 1.0, 1.0]),
    (None, 1, [1.0, 1.0, 1.0]),
    (None, 2, [1.0, 1.0, 1.0]),
    (40, 1, [1.0, 1.0, 1.0]),
    (40, 1, [1.0, 1.0, 1.0]),
    (40, 1, [1.0, 1.0, 1.0]),
    (40, 2, [1.0, 1.0, 1.0]),
    (41, 2, [0.9, 1.0, 0.9]),
    (45, 3, [-1.0, -1.0, -1.0]),
    (50, 1, [1e30, 1.0, 1.0]),
    (51, 2, [9e29, 1.0, 1.0]),
    (55, 1, [3e5, 2e5, 1e5]),
    (56, 2, [3e5, 2e5, 1e5 + 1 / 64]),
    (57, 1, [3e5, 2e5, 1e5 + 1 / 64]),
]


@pytest.mark.parametrize(
    "rows,every",
    [
        (ODD, 5),
        (random_rows(300, 8, [-1.0, -0.5, 0.25, 0.5, 1.0], [1, 2], 1), 3),
        (random_rows(200, 4, [0.0, 1.0], [1, 2, None], 2) + [(i, i % 3, [1.0] * 4) for i in range(200, 400)], 10),
        (random_rows(200, 6, [x / 7 for x in range(-9, 20)], list(range(80)), 3), 4),
        ([], 5),
        ([(3, 1, [1.0])], 5),
    ],
)
def test_hard_negatives_equal_brute_force(spark, rows, every):
    frame = spark.createDataFrame(rows, "id long, label long, vector array<double>").repartition(3)
    for block_bytes in (1 << 25, 500):
        with Scratch(spark) as scratch:
            out = hardneg.mine(frame, F.col("id") % every == 0, scratch, block_bytes=block_bytes)
            got = sorted(map(tuple, out.collect()), key=str)
        assert got == mined(rows, every)


def test_tiles_and_windows(spark, monkeypatch):
    rows = random_rows(250, 5, [x / 5 for x in range(-3, 6)], [1, 2, 3], 7)
    monkeypatch.setattr(hardneg, "TILE", 64)
    held = hardneg.Best(3, 2)
    import numpy as np

    held.add(np.array([0, 0, 0, 2]), np.array([5, 5, 9, 1]), np.array([7, 3, 1, 4]), np.array([False, False, False, True]))
    held.add(np.array([0, 2]), np.array([5, 1]), np.array([2, 9]), np.array([False, False]))
    at, score, ids = held.entries()
    assert (at.tolist(), score.tolist(), ids.to_pylist()) == ([0, 0, 2, 2], [9, 5, 1, 1], [1, 2, 9, None])
    frame = spark.createDataFrame(rows, "id long, label long, vector array<double>")
    with Scratch(spark) as scratch:
        out = hardneg.mine(frame, F.col("id") % 9 == 0, scratch, low=50, high=120, positives=3, negatives=3)
        assert sorted(map(tuple, out.collect()), key=str) == mined(rows, 9, 50, 120, 3)


def test_vectors_in_floats_and_clashing_columns(spark, tmp_path):
    rows = [(i, i % 3, [((i * k) % 11) / 11 - 0.3 for k in range(1, 9)], "mine") for i in range(0, 600)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, score string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()
    want = mined([(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in got], 100)
    out = queries.QUERIES["op11_hard_negatives"](spark, str(tmp_path))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, out.collect()), key=str) == want


def compressed(rows, parts=4, entries=256, rounds=4):
    """By the definition, over whole numbers of Python; rows of (id, label, vector)."""
    rows = [r for r in rows if _kept(r[2])]
    width = -(-max((len(r[2]) for r in rows), default=0) // parts)
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    whole = [[math.floor(1024 * x) for x in r[2]] + [0] * (parts * width - len(r[2])) for r in rows]
    whole = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[v[p] for v in whole[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda p, x: min((far(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            chose = [near(p, v[p])[1] for v in whole]
            for e in range(len(books[p])):
                if got := [v[p] for v, c in zip(whole, chose, strict=True) if c == e]:
                    books[p][e] = [sum(y) // len(got) for y in zip(*got, strict=True)]
    found = [[near(p, v[p]) for p in range(parts)] for v in whole]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(rows, errors, strict=True):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    digest = hashlib.sha256(",".join(str(y) for p in books for c in p for y in c).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in f), err, by_label[r[1]], digest) for r, f, err in zip(rows, found, errors, strict=True)), key=str)


CODED = [
    (random_rows(400, 8, [-1.0, -0.5, 0.25, 0.3, 0.5, 1.0], ["a", "b", None], 4), 16),
    (random_rows(300, 10, [x / 9 for x in range(-9, 10)], ["a", "b"], 5), 256),
    ([(None if i % 5 == 0 else i % 40, "a", [0.5] * 8) for i in range(200)] + random_rows(50, 8, [0.0, 1.0], [None], 6), 8),
    ([(1, "a", None), (2, None, [NAN, 1.0]), (3, "a", [1.0, None]), (4, "b", []), (5, "b", [0.1]), (6, None, [INF]), (7, "c", [-3.3, 2.0, 1.0, 4.0, 900.0])], 256),
    ([(1, "a", [1.0] * 4)], 256),
    ([], 256),
]


@pytest.mark.parametrize("rows,entries", CODED)
def test_codes_equal_brute_force(spark, rows, entries):
    frame = spark.createDataFrame(rows, "id long, label string, vector array<double>").repartition(3)
    with Scratch(spark) as scratch:
        out = vectorcode.compress(frame, scratch, entries=entries).drop("label")
        assert sorted(map(tuple, out.collect()), key=str) == compressed(rows, entries=entries)


def test_codes_in_floats_and_clashing_columns(spark, tmp_path):
    rows = [(i, i % 3 or None, [((i * k) % 11) / 11 - 0.3 for k in range(1, 9)], "mine", "mine") for i in range(0, 500)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, code string, error string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()
    out = queries.QUERIES["op12_vector_codes"](spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == compressed([(r["vec_id"], r["label"], r["embedding"]) for r in got])


def test_large_components_are_held(spark):
    rows = [(1, "a", [1e30, 0.0, 0.0, 1.0]), (2, "a", [-1e30, 0.0, 0.0, 1.0]), (3, "a", [3.0, 0.0, 0.0, 1.0])]
    frame = spark.createDataFrame(rows, "id long, label string, vector array<double>")
    held = vectorcode.most(1) / 1024
    with Scratch(spark) as scratch:
        out = vectorcode.compress(frame, scratch, entries=2).drop("label")
        assert sorted(map(tuple, out.collect()), key=str) == compressed([(i, k, [max(-held, min(held, x)) for x in v]) for i, k, v in rows], entries=2)
