"""Language identification by string kernels.

The kernel of two texts is the number of distinct character n-grams, n = 1 to 5, that both contain
(a blended-spectrum presence kernel), divided by the root of the product of their own numbers.
n-grams of the lower-cased text are held as presence bits over 2**18 hashed buckets. A bounded set of
landmark texts gives the Nyström map K_mm^(-1/2) k_m(x); one-versus-rest ridge regression on it is
fitted to 0/1 targets. The kernel is an inner product of presence vectors, so landmarks, Nyström map
and ridge weights multiply out to one matrix of bucket x language, and a batch of whole texts is
scored by the product of its (sparse) presence matrix with that one.

Defined results: texts that are null, empty or without a letter are `und` with score 0, as all are where no row is labelled. Null
languages and texts teach nothing, nor does a row of null doc_id, whose fold isn't known. Long texts are hashed whole, in windows.
Ties go to the language first by code point. Rows that repeat are predicted alike and come back as often as they came; in the
sample they count as often as they are drawn. Columns named lang_pred or score are replaced, others kept. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

BITS = 18
LONGEST_GRAM = 5
UNKNOWN = "und"
#: Below this score a text is in no language that the model knows, such as one in a foreign script. Of 10,000
#: labelled texts, one-word and junk ones among them, none has less than 0.14; Russian and Japanese have 0.03 and less.
FLOOR = 0.05
LETTER = r"\p{L}"
#: Languages whose weights are broadcast together: 2**BITS floats each, 128 MB in all.
LANGS = 128
#: Code points that are hashed at once; a worker needs about a hundred times that. Longer texts are cut into windows.
PIECE = 1 << 20


@dataclass(frozen=True)
class Model:
    """langs: the learned values by code point; weights: float32[2**BITS, len(langs)]."""

    langs: list[str]
    weights: np.ndarray


def presence(texts: list[str]) -> list[np.ndarray]:
    """Of each text the sorted distinct buckets of its n-grams, over the whole text."""
    flags, found, held = np.zeros(1 << BITS, dtype=bool), [], []

    def hashed(parts: list[np.ndarray]):
        """For each part the buckets of its n-grams, an array for each n."""
        whole = np.concatenate(parts)
        grams, seen = np.zeros(len(whole), dtype=np.uint32), []
        for n in range(LONGEST_GRAM):
            # grams[i] hashes the code points i .. i+n; what runs over a part's end is cut off below
            grams = grams[: max(0, len(whole) - n)] * np.uint32(0x01000193) + (whole[n:] + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
            mixed = grams ^ (grams >> np.uint32(15))
            seen.append((mixed * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))
        at = 0
        for part in parts:
            yield [bucket[at : max(at, at + len(part) - n)] for n, bucket in enumerate(seen)]
            at += len(part)

    def put_out() -> None:
        for buckets in hashed(held) if held else ():
            flags[:] = False
            for b in buckets:
                flags[b] = True
            found.append(np.flatnonzero(flags))
        held.clear()

    size = 0
    for t in texts:
        low = t.lower()
        if size + len(low) > PIECE:
            put_out()
            size = 0
        if len(low) <= PIECE:
            held.append(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
            size += len(low)
            continue
        seen = np.zeros(1 << BITS, dtype=bool)
        for i in range(0, len(low), PIECE):  # windows overlap, so that each n-gram lies in one
            window = low[i : i + PIECE + LONGEST_GRAM - 1].encode("utf-32-le", "surrogatepass")
            for buckets in hashed([np.frombuffer(window, dtype=np.uint32)]):
                for b in buckets:
                    seen[b] = True
        found.append(np.flatnonzero(seen))
    put_out()
    return found


def _shipped(grams: np.ndarray) -> bytes:
    """Buckets as numbers or, where that is shorter, as bits: 32 KB at most."""
    if len(grams) * 32 < 1 << BITS:
        return grams.astype(np.int32).tobytes()
    flags = np.zeros(1 << BITS, dtype=bool)
    flags[grams] = True
    return np.packbits(flags).tobytes()


def _received(data: bytes) -> np.ndarray:
    if len(data) * 8 < 1 << BITS:
        return np.frombuffer(data, dtype=np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8)))


def _pieces(batches, *columns):
    for piece, _ in (x for b in batches for x in slices([b], "text", PIECE)):
        yield [piece.column(piece.schema.get_field_index(c)) for c in columns]


def learn(
    rows: DataFrame,
    per_lang: int = 400,
    most: int = 4000,
    landmarks: int = 32,
    most_landmarks: int = 256,
    ridge: float = 0.1,
) -> Model:
    """Fit on a bounded sample of rows(doc_id, text, lang).

    The sample holds about per_lang texts of each language and `most` in all, drawn by a hash of
    doc_id; landmarks of a language are the first of its drawn texts in that order, most_landmarks in
    all at most. Every value of lang is learned, from one text and one landmark at least, so these bounds give way where
    there are more languages than they allow. Rows whose text or
    lang is null or whose text has no letter are left out. Without any row left the model knows no language,
    and every prediction is `und`. The driver holds 32 KB for each text of the sample at most.
    """
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), dtype=np.float32))
    each = max(1, min(per_lang, most // len(langs)))
    marks = max(1, min(landmarks, most_landmarks // len(langs)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(20240501)), F.lit(1 << 40))
    # A little over `each` are drawn in expectation; the cut to `each` is made below, in order of draw.
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, 1.3 * (each + 20) / n) * (1 << 40))))])
    drawn = rows.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")])

    def encode(batches):
        for lang, draws, text in _pieces(batches, "lang", "draw", "text"):
            grams = [zlib.compress(_shipped(g), 1) for g in presence(text.to_pylist())]
            yield pa.RecordBatch.from_arrays([lang, draws, pa.array(grams, pa.binary())], names=["lang", "draw", "grams"])

    sample: dict[str, list] = {k: [] for k in langs}
    for r in drawn.mapInArrow(encode, "lang string, draw long, grams binary").toLocalIterator():
        sample[r["lang"]].append((r["draw"], bytes(r["grams"])))
    unpacked = lambda g: _received(zlib.decompress(g))
    ordered = {k: [g for _, g in sorted(v, key=lambda x: (x[0], zlib.decompress(x[1])))[:each]] for k, v in sample.items()}
    chosen = [unpacked(g) for k in langs for g in ordered[k][:marks]]
    texts = [(i, g) for i, k in enumerate(langs) for g in ordered[k]]
    held = np.zeros((1 << BITS, len(chosen)), dtype=np.uint8)
    for j, g in enumerate(chosen):
        held[g, j] = 1
    norm = 1 / np.sqrt([len(g) for g in chosen])
    kernel = lambda g: held[g].sum(0, dtype=np.int64) * norm / np.sqrt(len(g))
    k_mm = np.array([kernel(g) for g in chosen])
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    half = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    phi = np.array([kernel(unpacked(g)) for _, g in texts]) @ half
    target = np.eye(len(langs))[[i for i, _ in texts]]
    weight = np.linalg.solve(phi.T @ phi + ridge * np.eye(len(chosen)), phi.T @ target)
    alpha = (half @ weight) * norm[:, None]
    weights = np.empty((1 << BITS, len(langs)), dtype=np.float32)
    for at in range(0, 1 << BITS, 1 << 14):
        weights[at : at + (1 << 14)] = held[at : at + (1 << 14)] @ alpha
    return Model(langs, weights)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def scored(model: Model, texts: list[str | None]) -> tuple[list[str | None], list[float]]:
    """The language of greatest score of each text, and that score; none where the text has no letter or the model no language.

    Ties go to the language first by code point.
    """
    langs, scores = [None] * len(texts), [0.0] * len(texts)
    at = [i for i, t in enumerate(texts) if t and has_letter(t)] if model.langs else []
    if at:
        grams = presence([texts[i] for i in at])
        starts = np.cumsum([0, *map(len, grams[:-1])])
        sums = np.add.reduceat(model.weights[np.concatenate(grams)], starts, axis=0, dtype=np.float64)
        sums /= np.sqrt([[len(g)] for g in grams])
        best = sums.argmax(1)
        for i, k, row in zip(at, best, sums, strict=True):
            langs[i], scores[i] = model.langs[k], float(row[k])
    return langs, scores


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """scored() with `und` and 0 where there is no language, and scores cut to 0..1."""
    langs, scores = scored(model, texts)
    return [UNKNOWN if k is None else k for k in langs], [min(1.0, max(0.0, x)) for x in scores]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred string and score double added (columns of those names are replaced).

    Only text is read for the prediction; every row comes back, in whole, once. Languages are taken LANGS at a time: each
    block of the matrix is a broadcast of its own, and texts carry the best language so far from block to block.
    """
    docs = docs.drop("lang_pred", "score")
    blocks = [Model(model.langs[at : at + LANGS], model.weights[:, at : at + LANGS]) for at in range(0, len(model.langs), LANGS)] or [model]
    for n, block in enumerate(blocks):
        docs = _with_best(docs, block, first=n == 0, last=n == len(blocks) - 1)
    return docs


def _with_best(docs: DataFrame, block: Model, first: bool, last: bool) -> DataFrame:
    """docs with the better of their lang_pred and score and those of the block; the last block has `und` and cut scores."""
    known = docs.sparkSession.sparkContext.broadcast(block)  # 2**BITS x LANGS floats at most
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    text = docs.schema.names.index("text")

    def run(batches):
        for piece, _ in slices(batches, "text", PIECE):
            langs, scores = scored(known.value, piece.column(text).to_pylist())
            if not first:
                before = zip(piece.column("lang_pred").to_pylist(), piece.column("score").to_pylist(), strict=True)
                # texts that have a language here have had one before
                both = [(k, x) if k is None or x >= y else (j, y) for (k, x), (j, y) in zip(before, zip(langs, scores, strict=True), strict=True)]
                langs, scores = [k for k, _ in both], [x for _, x in both]
            if last:
                langs, scores = [UNKNOWN if k is None else k for k in langs], [min(1.0, max(0.0, x)) for x in scores]
            kept = [piece.column(piece.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in fields), "lang_pred", "score"])

    out = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, out)


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 3; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def learned_from(docs: DataFrame) -> Model:
    """A model of docs(doc_id, text, lang) outside the held-out fold (remainder 1); a null doc_id is left out."""
    return learn(docs.where(fold(F.col("doc_id")) != 1).select("doc_id", "text", "lang"))
