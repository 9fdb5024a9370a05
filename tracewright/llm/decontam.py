"""Benchmark decontamination by latent semantic retrieval.

Items of a benchmark (the stated query set) are looked for in all passages of all documents, whole
texts. Words are lower-cased runs without white space and ASCII punctuation; only words of the items
have a place in the vectors, so the vocabulary is bounded by the benchmark.

1. Every document is encoded once, as the vocabulary numbers of its words in order.
2. Document frequencies of words over all passages (PASSAGE words each) give TF-IDF weights.
3. A randomised SVD of the passage x word matrix A: the range of A'A is found from Gaussian probes and
   from the items' own vectors, sums over partitions being reduced by blocks of words; A is then
   projected on that range, and the eigenvectors of the small Gram matrix give the latent space.
   (Halko, Martinsson and Tropp, 2011.) DIRECTIONS random mixtures of the items' directions, which span those of as
   many items, keep an item and a passage that holds it close in the latent space.
4. Windows of each document, long enough to hold an item wherever it starts, are compared with the
   items in the latent space, a batch of windows by a matrix product.
   Of an item of at most SHORT words such a window is mostly foreign text, and its cosine can be low. So
   these are also looked for by their rarest words, in windows that fit them: a match has LCS_SHARE of an
   item's n words, so it has HITS of the rarest n - LCS_SHARE n + HITS, and a window of n words and half
   as many more before and after. No window that verifies is missed by this.
5. Each candidate is verified: longest common subsequence of item and window, as a share of the item,
   and the same of the item's answer, its last sentence. Both allow for inserted, dropped and replaced
   words, that is, for paraphrases.

Defined results: one row for each row of documents and item that it leaks. Null or empty texts leak
nothing, nor do items without words match. A null doc_id is carried as it is. Without items or without
documents the result is empty. Long texts are searched in windows from end to end. Items that repeat exactly (item_id and text) count once,
and rows of documents that repeat give a row each. Of windows of one document and item that tie the first that was found gives the cosine.
Columns other than doc_id, text and item_id don't matter; clean() keeps those of documents, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, discard, slices, stored

CHUNK = 32
PASSAGE = 2 * CHUNK
PROBES = 32
#: Items of a query block; the range of the SVD has so many directions and PROBES at most.
BLOCK = 1024
#: Items that the driver holds at a time.
SHARE = 64 * BLOCK
DIRECTIONS = 64
RANK = 88
#: Words in more passages than this share are stop words, but in items that have few others.
STOP_SHARE = 0.05
LEAST_WORDS = 4
COSINE = 0.4
LCS_SHARE = 0.7
ANSWER_SHARE = 0.7
#: Items of so many words at most have windows of CHUNKs that may be foreign for the greater part.
SHORT = CHUNK + 1
HITS = 3

_SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def answer_of(text: str) -> list[bytes]:
    """The words of the last sentence that has any."""
    return next((w for s in reversed(re.split(r"[.!?\n]+", text)) if (w := tokens(s))), [])


def lcs(masks: dict[int, int], length: int, window: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the pattern (Hyyrö, 2004)."""
    ones = (1 << length) - 1
    v = ones
    for t in window:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & ones
    return length - v.bit_count()


def masks_of(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(ids):
        out[x] = out.get(x, 0) | (1 << i)
    return out


@dataclass(frozen=True)
class Items:
    """Items: ids, words as vocabulary numbers, answers likewise, the vocabulary."""

    item_ids: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        number = lambda ws: [vocabulary.setdefault(w, len(vocabulary)) for w in ws]
        words = [number(tokens(t)) for _, t in rows]
        return cls([i for i, _ in rows], words, [number(answer_of(t)) for _, t in rows], vocabulary)


    def block(self, at: int) -> tuple[Items, np.ndarray]:
        """BLOCK items from the at-th on with a vocabulary of their own, and its number of each word of this one, -1 for others."""
        some = slice(at, at + BLOCK)
        used = sorted({x for w in (*self.words[some], *self.answers[some]) for x in w})
        local = np.full(len(self.vocabulary), -1, dtype=np.int32)
        local[used] = np.arange(len(used))
        names = list(self.vocabulary)
        moved = lambda rows: [local[w].tolist() for w in rows]
        return Items(self.item_ids[some], moved(self.words[some]), moved(self.answers[some]), {names[x]: i for i, x in enumerate(used)}), local


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def _encoded(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, ids: the vocabulary number of each word, -1 for words of no item."""
    known = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches):
        number = _Numbers(known.value)
        for piece, _ in slices(batches, "text"):
            out = []
            for text in piece.column(1).to_pylist():
                w = tokens(text)
                out.append(np.fromiter(map(number.__getitem__, w), dtype=np.int32, count=len(w)).tobytes())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def _for_block(encoded: DataFrame, local: np.ndarray) -> DataFrame:
    """The encoded documents in the numbers of a block."""
    known = encoded.sparkSession.sparkContext.broadcast(local)

    def run(batches):
        for piece, _ in slices(batches, "ids"):
            ids = [np.frombuffer(x, dtype=np.int32) for x in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([np.where(x < 0, -1, known.value[x]).astype(np.int32).tobytes() for x in ids], pa.binary())], names=["doc_id", "ids"])

    return encoded.mapInArrow(run, "doc_id long, ids binary")


def _units(batches, size: int, gap: int = 0) -> Iterator[tuple[list, tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, int]]:
    """For pieces of the encoded table: doc_ids, first and end unit of each document, words and units of all
    known words in order, and the number of units. A unit is `size` words; gap empty ones part documents."""
    for piece, _ in slices(batches, "ids", 1 << 20):
        raw = [np.frombuffer(x, dtype=np.int32) for x in piece.column(1).to_pylist()]
        lengths = np.array([len(x) for x in raw])
        counts = -(-lengths // size) + gap
        first = np.cumsum(counts) - counts
        whole = np.concatenate(raw)
        within = np.arange(len(whole)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        unit = np.repeat(first, lengths) + within // size
        at = whole >= 0
        yield piece.column(0).to_pylist(), (first, first + counts - gap), whole[at], unit[at], int(counts.sum())


def _summed(values: np.ndarray, rows: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """values[rows] added up by the ascending `where` into an array of n rows."""
    out = np.zeros((n, values.shape[1]), dtype=np.float32)
    if len(rows):
        starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        out[where[starts]] = np.add.reduceat(values[rows], starts, axis=0)
    return out


def _reduced(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of parts(block, data): partial blocks of rows, added up by block on the executors."""
    spark = parts.sparkSession

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data, dtype=np.float64)
                total[block] = total[block] + x if block in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "data"])

    n = max(1, min(-(-shape[0] // ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    out = np.zeros((-(-shape[0] // ROWS) * ROWS, shape[1]))
    for r in parts.repartition(n, "block").mapInArrow(add, "block int, data binary").toLocalIterator():
        out[r["block"] * ROWS : (r["block"] + 1) * ROWS] = np.frombuffer(r["data"], dtype=np.float64).reshape(ROWS, -1)
    return out[: shape[0]]


#: Rows of a block in which partial matrices are reduced.
ROWS = 16


def _blocks(matrix: np.ndarray) -> pa.RecordBatch:
    padded = np.zeros((-(-len(matrix) // ROWS) * ROWS, matrix.shape[1]))
    padded[: len(matrix)] = matrix
    data = [padded[i : i + ROWS].tobytes() for i in range(0, len(padded), ROWS)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(data)), pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])


def _frequencies(encoded: DataFrame, v: int) -> tuple[np.ndarray, int]:
    """In how many passages each word is, and the number of passages."""

    def run(batches):
        df, n = np.zeros(v, dtype=np.int64), 0
        for _, _, words, unit, units in _units(batches, PASSAGE):
            df += np.bincount(np.unique(unit * v + words) % v, minlength=v)
            n += units
        yield pa.RecordBatch.from_arrays([pa.array([*range(v), -1], pa.int32()), pa.array([*df.tolist(), n], pa.int64())], names=["word", "n"])

    out, n = np.zeros(v, dtype=np.int64), 0
    for r in encoded.mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r["word"] < 0:
            n = r["n"]
        else:
            out[r["word"]] = r["n"]
    return out, n


def _range(encoded: DataFrame, weighted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A'A Omega for the TF-IDF matrix A of all passages; weighted: Omega, rows times idf."""
    known = encoded.sparkSession.sparkContext.broadcast((weighted, idf > 0))

    def run(batches):
        w, used = known.value
        g = np.zeros(w.shape)
        for _, _, words, unit, units in _units(batches, PASSAGE):
            at = used[words]
            words, unit = words[at], unit[at]
            y = _summed(w, words, unit, units)
            order = np.argsort(words, kind="stable")
            g += _summed(y, unit[order], words[order], len(w))
        yield _blocks(g)

    return _reduced(encoded.mapInArrow(run, "block int, data binary"), weighted.shape) * idf[:, None]


def _gram(encoded: DataFrame, weighted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(A Q)'(A Q); weighted: Q, rows times idf."""
    known = encoded.sparkSession.sparkContext.broadcast((weighted, idf > 0))

    def run(batches):
        w, used = known.value
        s = np.zeros((w.shape[1], w.shape[1]))
        for _, _, words, unit, units in _units(batches, PASSAGE):
            at = used[words]
            z = _summed(w, words[at], unit[at], units)
            s += z.T @ z
        yield _blocks(s)

    return _reduced(encoded.mapInArrow(run, "block int, data binary"), (weighted.shape[1],) * 2)


def _latent(encoded: DataFrame, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """The idf of each word (0 for stop words), and the latent space: float32[words, rank]."""
    v = len(items.vocabulary)
    df, n = _frequencies(encoded, v)
    content = df <= STOP_SHARE * n
    for words in items.words:
        if len({w for w in words if content[w]}) < LEAST_WORDS:
            content[words] = True
    idf = np.where(content, np.maximum(1e-3, np.log((1 + n) / (1 + df))), 0.0)
    rng = np.random.default_rng(12)
    omega = rng.standard_normal((v, PROBES))
    g = _range(encoded, (omega * idf[:, None]).astype(np.float32), idf)
    own = np.zeros((v, len(items.words)))
    for j, words in enumerate(items.words):
        np.add.at(own[:, j], words, idf[words])
    own = own @ rng.standard_normal((own.shape[1], DIRECTIONS))
    both = np.hstack([m / np.maximum(1e-12, np.linalg.norm(m, axis=0)) for m in (g, own)])
    left, size, _ = np.linalg.svd(both, full_matrices=False)
    q = left[:, size > 1e-9 * max(size.max(), 1e-12)]
    s = _gram(encoded, (q * idf[:, None]).astype(np.float32), idf)
    _, vectors = np.linalg.eigh(s)
    return idf, (q @ vectors[:, ::-1][:, :RANK]).astype(np.float32)


def _anchors(words: list[list[int]], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the items of at most SHORT words: the rarest words that a match must have HITS of.

    Words ascending with the item and the place in it of each, and HITS (all that a match has, if fewer) of each item.
    """
    rows, hits = [], np.ones(len(words), dtype=np.int64)
    for j, own in enumerate(words):
        if 0 < len(own) <= SHORT:
            need = next(k for k in range(1, len(own) + 1) if k / len(own) >= LCS_SHARE)
            hits[j] = min(HITS, need)
            rare = sorted(range(len(own)), key=lambda k, own=own: -idf[own[k]])[: len(own) - need + hits[j]]
            rows += [(own[k], j, k) for k in rare]
    word, item, place = (np.array(c, dtype=np.int64) for c in (zip(*sorted(rows), strict=True) if rows else [()] * 3))
    return word, item, place, hits


def _fitted(text: np.ndarray, anchors: tuple, sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """item, start, end and first anchor of the windows of text (words of documents in a row, -1 for words of no item) that have enough anchors."""
    word, item, place, hits = anchors
    lo, n = np.searchsorted(word, text), np.searchsorted(word, text, "right")
    n -= lo
    at = np.flatnonzero(n)
    n, lo = n[at], lo[at]
    pos = np.repeat(at, n)
    row = np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    j, k = item[row], place[row]
    order = np.lexsort((pos, j))
    j, k, pos = j[order], k[order], pos[order]
    slack = np.maximum(2, sizes[j] // 2)
    last = np.arange(len(j)) + hits[j] - 1
    inside = last < len(j)
    last = np.minimum(last, len(j) - 1)
    start = pos - k - slack
    good = inside & (j[last] == j) & (pos[last] < start + sizes[j] + 2 * slack)
    found = np.unique(np.stack([j[good], start[good], (start + sizes[j] + 2 * slack)[good], pos[good]]), axis=1)
    yield from zip(*found.tolist(), strict=True)


def _search(encoded: DataFrame, items: Items, idf: np.ndarray, space: np.ndarray) -> DataFrame:
    weighted = (space * idf[:, None]).astype(np.float32)
    scales: dict[int, list[int]] = {}
    for j, words in enumerate(items.words):
        if words:
            scales.setdefault((len(words) + CHUNK - 2) // CHUNK + 1, []).append(j)
    vectors = np.zeros((len(items.words), space.shape[1]), dtype=np.float32)
    for j, words in enumerate(items.words):
        if words:
            x = weighted[words].sum(0)
            vectors[j] = x / max(1e-12, float(np.linalg.norm(x)))
    anchors = _anchors(items.words, idf)
    known = encoded.sparkSession.sparkContext.broadcast((items.item_ids, items.words, items.answers, weighted, idf > 0, scales, vectors, anchors))

    def run(batches):
        item_ids, words_of, answers, w, used, by_scale, q, anchors = known.value
        sizes = np.array([len(x) for x in words_of])
        masks = [masks_of(x) for x in words_of]
        own_masks = [masks_of(x) for x in answers]
        most = max(by_scale, default=1)
        # cut as _units cuts, so that one piece gives one round of it
        for piece, _ in slices(batches, "ids", 1 << 20):
            rows: list[tuple] = []
            for doc_ids, (first, end), words, unit, units in _units([piece], CHUNK, most - 1):
                at = used[words]
                z = _summed(w, words[at], unit[at], units)
                found: dict[tuple[int, int], tuple] = {}
                windows = z
                for m in range(1, most + 1):
                    if m > 1:
                        windows = windows[:-1] + z[m - 1 :]
                    if m not in by_scale or not len(windows):
                        continue
                    chosen = np.array(by_scale[m])
                    near = windows @ q[chosen].T
                    near /= np.maximum(1e-12, np.sqrt(np.einsum("ij,ij->i", windows, windows)))[:, None]
                    for i, k in np.argwhere(near >= COSINE):
                        j, doc = int(chosen[k]), int(np.searchsorted(first, i, "right")) - 1
                        if i >= end[doc]:  # it starts in the gap and reaches into the next document
                            continue
                        if (doc, j) in found and found[doc, j][1] == 1.0:
                            continue
                        lo, hi = np.searchsorted(unit, (i, i + m))
                        window = words[lo:hi].tolist()
                        share = lcs(masks[j], len(words_of[j]), window) / len(words_of[j])
                        if share < LCS_SHARE:
                            continue
                        answer = lcs(own_masks[j], len(answers[j]), window) / len(answers[j])
                        if answer >= ANSWER_SHARE and share > found.get((doc, j), (0, 0))[1]:
                            found[doc, j] = (float(near[i, k]), share, answer)
                raw = [np.frombuffer(x, dtype=np.int32) for x in piece.column(1).to_pylist()]
                ends = np.cumsum([len(x) for x in raw])
                for j, start, stop, hit in _fitted(np.concatenate(raw), anchors, sizes) if len(anchors[0]) else ():
                    doc = int(np.searchsorted(ends, hit, "right"))
                    if found.get((doc, j), (0, 0))[1] == 1.0:
                        continue
                    before = int(ends[doc]) - len(raw[doc])
                    window = raw[doc][max(0, start - before) : stop - before]
                    window = window[window >= 0].tolist()
                    share = lcs(masks[j], len(words_of[j]), window) / len(words_of[j])
                    if share < LCS_SHARE:
                        continue
                    answer = lcs(own_masks[j], len(answers[j]), window) / len(answers[j])
                    if answer >= ANSWER_SHARE and share > found.get((doc, j), (0, 0))[1]:
                        x = w[window].sum(0)
                        found[doc, j] = (float(x @ q[j]) / max(1e-12, float(np.linalg.norm(x))), share, answer)
                rows += [(doc_ids[d], item_ids[j], *x) for (d, j), x in found.items()]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.float64()] * 3), strict=True)], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    return encoded.mapInArrow(run, LEAKS)


LEAKS = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share of every leak of benchmark(item_id, text) into docs(doc_id, text).

    The benchmark is the query set. The driver reads it in shares of SHARE items, so what it holds and broadcasts is bounded
    by their length; the documents are encoded once a share and searched for a block of BLOCK of its items at a time.
    """
    spark = docs.sparkSession
    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct().sort("item_id", "text").toLocalIterator()
    asked = ((r["item_id"], r["text"]) for r in rows if tokens(r["text"]))
    out = spark.createDataFrame([], T._parse_datatype_string(LEAKS))
    while share := list(islice(asked, SHARE)):
        items = Items.of(share)
        encoded, path = stored(_encoded(docs, items), "encoded")
        for at in range(0, len(share), BLOCK):
            block, local = items.block(at) if len(share) > BLOCK else (items, None)
            own = encoded if local is None else _for_block(encoded, local)
            idf, space = _latent(own, block)
            out = out.union(checkpointed(_search(own, block, idf, space)))
        discard(spark, path)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id leaks no item. A null doc_id counts as one id."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("__leaking")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__leaking"]), "left_anti")
