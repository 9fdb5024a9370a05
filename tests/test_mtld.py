"""Factors by blocks are those of the fold over the whole list."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions.text import _factors, mtld_of
from tracewright.operators import corpus, mtld


def rows_of(spark, tokens, cut):
    """Tokens as utterances of `cut` tokens, whose order isn't the order of the rows."""
    rows = [(i // 7, i % 7, tokens[at : at + cut]) for i, at in enumerate(range(0, len(tokens), cut))]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g int, position long, toks array<string>").repartition(3)


def lists():
    draw = random.Random(4)
    return {
        "few words": draw.choices("abcdefghij", k=400),
        "zipf": [f"w{int(draw.paretovariate(0.7))}" for _ in range(900)],
        "all different, then repeats": [f"u{i}" for i in range(120)] + ["a", "b"] * 60 + [f"v{i}" for i in range(60)],
        "all different": [f"u{i}" for i in range(150)],
        "one": ["a"],
        "the same": ["a"] * 41,
        "none": [],
    }


@pytest.mark.parametrize("name,size", [("few words", 16), ("zipf", 50), ("zipf", 1 << 16), ("all different, then repeats", 16), ("all different", 64), ("one", 16), ("the same", 16), ("none", 16)])
def test_factors_equal_the_fold(spark, name, size):
    tokens = lists()[name]
    found = mtld.factors(mtld.placed_tokens(rows_of(spark, tokens, 11), "g", "position"), size)
    want = (len(tokens), _factors(tokens, 0.72), _factors(tokens[::-1], 0.72))
    assert found == pytest.approx(want, abs=1e-9)


def test_blocks_are_several_tasks(spark):
    tokens = mtld.placed_tokens(rows_of(spark, lists()["zipf"], 11), "g", "position")
    own = F.floor(F.col("place") / 50)
    blocks = tokens.select("back", "place", "token", "total", F.explode(F.array(own, own - 1)).alias("block")).where("block >= 0")
    sizes = blocks.groupBy("back", "block").count().collect()
    assert len(sizes) == 2 * 18 and max(r["count"] for r in sizes) <= 100


def test_corpus(spark):
    words = lists()["zipf"]
    utterances = [(str(i // 5), i % 5, " ".join(words[at : at + 9])) for i, at in enumerate(range(0, len(words), 9))]
    frame = spark.createDataFrame(utterances, "group_id string, position long, question string")
    assert corpus.corpus_mtld(frame, block=64).first()["mtld"] == round(mtld_of(words), 4)
    assert corpus.corpus_mtld(frame.limit(0)).first()["mtld"] == 0.0
