"""Token counts against the library itself on whole texts."""

import random
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece

from tracewright.llm import queries, tokencount
from tracewright.llm.common import Scratch

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = Path(PATH).read_bytes()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


ODD = [
    None,
    "",
    " ",
    "  ",
    "\n",
    "\t \n  x",
    "<s> and </s> and <0x0A> <unk>",
    "▁▁ the ▁word▁",
    "  two   spaces    and\n\n   lines  ",
    "def f(x):\n        return {'a': x[0]}; // ...---===",
    "Grüße aus Übersee, être où ça; привет мир, 你好世界 こんにちは",
    "😀👩‍👩‍👧 é́​ x　y \x00 z ﻿",
    "12345 67,890.12 a1b2c3 x86_64 U.S.A. don't e.g.",
    "a" * 5_000,
    "ab" * 300 + " " + "word" * 200,
    " " * 1_000 + "end" + " " * 700,
    "=" * 999 + "-" * 999,
    "repeated row",
    "repeated row",
]


def test_counts_are_those_of_the_library(spark, library):
    random.seed(5)
    alphabet = "ab ▁ \n.,'\"()<>=-_0123456789éßñжя中国😀\t" + "theingersco"
    texts = ODD + ["".join(random.choices(alphabet, k=random.randint(1, 400))) for _ in range(300)]
    docs = spark.createDataFrame([(i if i % 7 else None, t, "mine", 1, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, n_bytes int, at long")
    want = {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(texts)}
    for most in (0, 40, 1 << 18):
        with Scratch(spark) as scratch:
            out = tokencount.counted(docs, MODEL, scratch, limit=100, most_shipped=most)
            assert out.columns == ["doc_id", "text", "at", "n_bytes", "n_tokens", "over_limit"]
            rows = out.collect()
        assert {r["at"]: (r["n_bytes"], r["n_tokens"]) for r in rows} == want
        assert len(rows) == len(texts) and all(r["over_limit"] == (r["n_tokens"] > 100) for r in rows)


def test_query_on_whole_texts(spark, small, library):
    out = queries.QUERIES["op13_token_counts"](spark, small)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d["doc_id"], len((d["text"] or "").encode()), n := len(library.encode(d["text"] or "")), n > 4096) for d in docs)
    assert sorted(map(tuple, out.collect())) == want


def test_cuts_hold_for_the_vocabulary(library):
    pieces = tokencount.Pieces(MODEL)
    text = "  Hello, (world)! x=3.14\n\tif a_b: 'yes' 中文字 naïve  "
    parts = [p for c in pieces.chunks(text) for p in pieces.pre_tokens(c)]
    assert "".join(parts) == "▁" + text.replace(" ", "▁")
    vocabulary = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    for a, b in zip(parts, parts[1:], strict=False):
        assert not any(a[-1] + b[0] in p for p in vocabulary)


def test_only_rare_pretokens_are_shuffled(spark):
    docs = spark.createDataFrame([(i, "the cat " * 50 + f"x{i}q") for i in range(200)], "doc_id long, text string")
    with Scratch(spark) as scratch:
        shipped = spark.sparkContext.broadcast(MODEL)
        counts = scratch.keep(tokencount.token_counts(docs, shipped), "t")
        common = tokencount._commonest(counts, 20)
        assert {"▁the", "▁cat"} <= set(common) and len(common) <= 20
        rows = counts.collect()
        assert len({r["token"] for r in rows}) == len(rows)
        assert {r["token"]: r["n"] for r in rows}["▁the"] == 200 * 50


def test_models_that_change_texts_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    for change in ("remove_extra_whitespaces", "byte_fallback"):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(MODEL)
        if change == "byte_fallback":
            proto.trainer_spec.byte_fallback = False
        else:
            proto.normalizer_spec.remove_extra_whitespaces = True
        with pytest.raises(ValueError):
            tokencount.Pieces(proto.SerializeToString())
