"""Near-duplicate documents by HyperMinHash, with exact confirmation and union-find.

Words are maximal runs without ASCII white space, A-Z lower-cased. A document's set holds its distinct
shingles of `size` words (or code points, for lines) (one shorter shingle if it has fewer words; none without words), each as a
64-bit hash. Documents a, b are linked when 100 * |a & b| >= percent * |a | b|, both not empty.

Sketch. 8 layers of 16 buckets; a layer rehashes every shingle, its top 4 bits name the bucket, and
the bucket keeps the least remaining hash as a 16-bit HyperMinHash register: the number of leading
zeros and the 10 mantissa bits after the first one (Yu and Weber, "HyperMinHash", 2017).

Candidates. Sets of over `small` shingles are banded: 32 bands of 4 compressed registers. A link of
Jaccard 0.8 shares a band but with probability (1 - 0.8**4)**32 = 5e-8. Smaller sets, whose buckets
would stay empty, take an exact way: the rarest shingles, as many as any link must meet (a prefix
filter in the order of hashed counts). Sets from percent * small up do both, so that no pair falls between.
Equal sets are one node, known by their fingerprint, before any of this.

Links. A bucket of two is a pair, and where sets have signs one of FEW members at most is its pairs; no other is expanded. Members of others first meet the bucket's hub, then the
member that is nearest to it; confirmed links are merged by distributed union-find; what can still be linked lies between members of
buckets with several components, and an exact positional prefix join finds it. Signs, where sets have them, drop
pairs that differ too much, without a loss (`can_be_linked`). Registers give a
collision-corrected estimate that drops pairs far (7 standard deviations) below the threshold; the rest is
confirmed on the full sets, recomputed from the whole texts.

Defined results: null or empty text, or text of white space, has 0 shingles and is its own component.
A null doc_id isn't linked: its component_id is null and it is kept. Rows that repeat a doc_id with
the same text come back as often as they came; with other texts they are documents of their own, each
linked by its own set. Other columns of the input don't matter. Long texts are hashed whole, to sets of as many shingles as they
have. Ties in doc_id as to which stays are of one id, so component_id is the same for all. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bitmap import bitmap, passes, sifted
from .common import Scratch, checkpointed, slices
from .components import components

MANTISSA = 10
ROWS = 4
EMPTY = 0xFFFF
#: Bits of the hashed counts by which shingles are put in order for the prefix join.
CELLS = 21
#: Places of a sign, bits.
SIGN = 512
#: Of sets with signs, members of a bucket whose pairs are all tried: signs leave few of them.
FEW = 32
#: Code points of lines that are compared at once: what a core's cache holds.
_TOGETHER = 1 << 15


@dataclass(frozen=True)
class Scheme:
    """How texts become sets, and sets sketches. There are 4 * layers bands of ROWS registers."""

    size: int = 5
    unit: str = "words"
    percent: int = 80
    layers: int = 8
    #: A layer has 2**bits buckets.
    bits: int = 4
    small: int = 128
    #: The estimate may lie this far below the threshold before a pair is dropped.
    slack: float = 0.25

    @property
    def registers(self) -> int:
        return self.layers << self.bits

    def least(self, n: int) -> int:
        """How many shingles a set linked with one of n must share with it at least."""
        return -(-self.percent * n // 100)

    def shingles(self, text: bytes | None) -> np.ndarray:
        return (shingles if self.unit == "words" else char_shingles)(text, self.size)


_SEEDS = np.array([xxhash.xxh3_64_intdigest(bytes([i]), seed=78) | 1 for i in range(16)], dtype=np.uint64)
_U = np.uint64
#: Joins the hash of a run of code points to that of what follows; odd.
_FACTOR = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


class _Words(dict):
    """Hashes of words, kept from document to document; emptied before it grows past its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole UTF-8 text."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=len(found))
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = h * _U(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
        h ^= h >> _U(31)
    return np.unique(_mix(h))


#: The hashes of the code points that most texts are of.
_POINTS = _mix(np.arange(1, (1 << 13) + 1, dtype=np.uint64))


def rolled(code: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` of the code points. Runs are joined of halves, so the work grows with log(size)."""
    h = _POINTS.take(code, mode="clip")
    rare = np.flatnonzero(code >= len(_POINTS))
    if len(rare):
        h[rare] = _mix(code[rare].astype(np.uint64) + _U(1))
    out, done, n = None, 0, 1
    while n <= size:
        if size & n:
            out = h if out is None else out[: max(0, len(h) - done)] * _U(pow(_FACTOR, n, 1 << 64)) + h[done:]
            done += n
        h = h[: max(0, len(h) - n)] * _U(pow(_FACTOR, n, 1 << 64)) + h[n:]
        n *= 2
    return _mix(out)


def char_shingles(text: bytes | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of runs of `size` code points of a whole UTF-8 text; one shorter run if it has fewer."""
    code = np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    return np.unique(rolled(code, min(size, len(code)))) if len(code) else np.empty(0, dtype=np.uint64)


def least_of(held: np.ndarray, owner: np.ndarray, n: int, scheme: Scheme) -> np.ndarray:
    """The least remaining hash in each bucket of n sets: uint32[n, registers], all bits where there is none.

    owner names the set of each shingle; shingles that repeat do no harm. Of parts of a set take the minimum.
    """
    width, bits = scheme.registers, np.uint32(32 - scheme.bits)
    least = np.full(n * width, 0xFFFFFFFF, dtype=np.uint32)
    base = owner.astype(np.intp) * width
    for layer in range(scheme.layers):
        # shingle hashes are mixed well, so the high bits of a product with an odd number rehash them
        g = ((held * _SEEDS[layer]) >> _U(32)).astype(np.uint32)
        at = base + (g >> bits)
        if layer:
            at += layer << scheme.bits
        np.minimum.at(least, at, g & np.uint32((1 << int(bits)) - 1))
    return least.reshape(n, width)


def packed(least: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The HyperMinHash registers of least hashes: uint16, EMPTY where a bucket got nothing."""
    wide = least.astype(np.float64).view(np.uint64)  # its exponent is the bit length, 1022 more; exact below 2**53
    zeros = (32 - scheme.bits) - np.maximum((wide >> _U(52)).astype(np.int32) - 1022, 0)
    mantissa = (wide >> _U(52 - MANTISSA)).astype(np.int32) & ((1 << MANTISSA) - 1)
    return np.where(least == 0xFFFFFFFF, EMPTY, (zeros << MANTISSA) | mantissa).astype(np.uint16)


def registers(held: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The HyperMinHash registers of one set: uint16[registers]."""
    return packed(least_of(held, np.zeros(len(held), dtype=np.intp), 1, scheme), scheme)[0]


def band_keys_of(regs: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """int64[n, bands]: a key of each band, of registers of different layers if there are several; and which bands have
    any register filled."""
    by_bucket = regs.reshape(len(regs), scheme.layers, 1 << scheme.bits).transpose(0, 2, 1)
    wide = by_bucket.reshape(len(regs), scheme.registers // ROWS, ROWS).astype(np.uint64)
    joined = wide[..., 0] | (wide[..., 1] << _U(16)) | (wide[..., 2] << _U(32)) | (wide[..., 3] << _U(48))
    keys = _mix(_mix(joined) + np.arange(1, joined.shape[1] + 1, dtype=np.uint64))
    return keys.view(np.int64), joined != _U(0xFFFFFFFFFFFFFFFF)


def band_keys(regs: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The keys of the bands of one set; bands without any register filled have none."""
    keys, filled = band_keys_of(regs[None], scheme)
    return keys[filled]


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers a, b of sets of n_a, n_b members."""
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & (a != EMPTY)).sum(1)
    ratio = np.maximum(n_a, n_b) / np.maximum(1, np.minimum(n_a, n_b))
    # expected share of buckets that agree by chance (HyperMinHash, approximate expected collisions)
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    share = same / np.maximum(1, used.sum(1))
    return np.maximum(0, (share - chance) / (1 - chance))


def sketches(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, hash (of the text), n (set size), fp (128-bit fingerprint of the set; null if empty), keys, regs, small.

    keys and regs are there for banded sets, small (all shingles) for those of the exact way.
    """
    paired = scheme.least(scheme.small + 1)

    def run(batches):
        for piece, _ in slices(batches, "text"):
            n, fp, keys, regs, small = [], [], [], [], []
            for text in piece.column(2).to_pylist():
                held = scheme.shingles(text)
                n.append(len(held))
                fp.append(xxhash.xxh3_128_digest(held.data) if len(held) else None)
                r = registers(held, scheme) if len(held) >= paired else None
                keys.append(None if r is None else band_keys(r, scheme))
                regs.append(None if r is None else r.tobytes())
                small.append(held.view(np.int64) if 0 < len(held) <= scheme.small else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, longs), pa.array(regs, pa.binary()), pa.array(small, longs)],
                names=["doc_id", "hash", "n", "fp", "keys", "regs", "small"],
            )

    return _hashed(docs).mapInArrow(run, "doc_id long, hash long, n long, fp binary, keys array<long>, regs binary, small array<long>")


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, hash, text binary: texts of one doc_id are told apart by their hashes."""
    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("hash"), text.alias("text"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("binary"))


def _cells(held: np.ndarray) -> np.ndarray:
    return (held.view(np.uint64) >> _U(64 - CELLS)).astype(np.int64)


#: Cells of a block in which partial counts are added up.
_BLOCK = 1 << 10


def _in_a_byte(counts: np.ndarray) -> np.ndarray:
    """Counts as uint8 in the same order: below 128 themselves, then in steps of 14 %, up to 2**31."""
    above = np.log2(np.clip(counts, 128, 2**31)) - 7
    return np.where(counts < 128, counts, 128 + above * (127 / 24)).astype(np.uint8)


def _cell_counts(sets: DataFrame, shingles_of) -> np.ndarray:
    """How many of the sets hold a shingle of each hashed cell, as _in_a_byte has it: 2 MB at any size of the input.

    shingles_of gives the sets of a batch. Tasks hand on blocks of counts, which are added up by block on the executors;
    the driver gets a byte of each cell, as only the order of counts matters, and which cells hold one set.
    """

    def count(batches):
        n = np.zeros(1 << CELLS, dtype=np.int64)
        for b in batches:
            for held in shingles_of(b):
                np.add.at(n, _cells(held), 1)
        blocks, data = n.reshape(-1, _BLOCK), []
        there = np.flatnonzero(blocks.any(axis=1))
        for b in blocks[there]:
            at = np.flatnonzero(b)
            # pairs (cell, count), or all counts of the block where that is shorter
            data.append(np.stack([at, b[at]]).tobytes() if 2 * len(at) < _BLOCK else b.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(data, pa.binary())], names=["block", "data"])

    def added(total: np.ndarray, block: int, data: bytes) -> None:
        x = np.frombuffer(data, dtype=np.int64)
        if len(x) == _BLOCK:
            total[block * _BLOCK : (block + 1) * _BLOCK] += x
        else:
            at, k = x.reshape(2, -1)
            total[block * _BLOCK + at] += k

    def add(batches):
        n = np.zeros(1 << CELLS, dtype=np.int64)
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                added(n, block, data)
        blocks = n.reshape(-1, _BLOCK)
        there = np.flatnonzero(blocks.any(axis=1))
        data = [x.tobytes() for x in _in_a_byte(blocks[there])]
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(data, pa.binary())], names=["block", "data"])

    schema = "block int, data binary"
    tasks = min(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << CELLS >> 10)
    found = sets.mapInArrow(count, schema).repartition(tasks, "block").mapInArrow(add, schema).toArrow()
    often = np.zeros((1 << CELLS >> 10, _BLOCK), dtype=np.uint8)
    for block, data in zip(found.column("block").to_pylist(), found.column("data").to_pylist(), strict=True):
        often[block] = np.frombuffer(data, dtype=np.uint8)
    return often.ravel()


def _prefix(held: np.ndarray, counts: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(t n) + 1 shingles of a set, rare ones first, and their places in that order.

    Two linked sets share one of these, whatever the order, as long as it is one for all sets. Shingles
    whose cell holds one set only are in no other and are left out; their places stay empty.
    """
    sets = counts[_cells(held)]
    first = np.lexsort((held, sets))[: len(held) - scheme.least(len(held)) + 1]
    at = np.flatnonzero(sets[first] > 1)
    return held[first[at]], at


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    return [x.values.to_numpy().view(np.uint64) for x in column.drop_null()]


def _keys(reps: DataFrame, counts, scheme: Scheme, wanted=None) -> DataFrame:
    """(key, id) of every bucket of reps(id, keys, small): band keys, and rare shingles of small sets.

    counts, and the bitmap of wanted keys if any, are broadcasts.
    """

    def run(batches):
        for b in batches:
            ids, banded, small = b.column(0), b.column(1), b.column(2)
            own, out = [], []
            there = ids.filter(banded.is_valid()).to_numpy()
            lists = banded.drop_null()
            out.append(lists.flatten().to_numpy())
            own.append(np.repeat(there, np.diff(lists.offsets.to_numpy())))
            for i, held in zip(ids.filter(small.is_valid()).to_pylist(), _lists(small), strict=True):
                key, _ = _prefix(held, counts.value, scheme)
                out.append(_mix(key ^ _U(0x5851F42D4C957F2D)).view(np.int64))
                own.append(np.full(len(key), i))
            key, own = np.concatenate(out), np.concatenate(own).astype(np.int64)
            if wanted is not None:
                mask = passes(wanted.value, key)
                key, own = key[mask], own[mask]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own)], names=["key", "id"])

    return reps.select("id", "keys", "small").mapInArrow(run, "key long, id long")


def _groups(sizes: list[int], most: int):
    """Runs of places whose sizes add up to `most` about."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if held:
        yield start, len(sizes)


def _shared(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of texts, one after the other, how many different runs of `size` code points both have and how many either has.

    All texts have such a run. Runs are told by their hashes, without the bits that the number of pairs takes, and one more.
    """
    n = len(texts) // 2
    windows = np.array([len(x) - size + 1 for x in texts])
    h = rolled(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), size)
    part = np.repeat(np.arange(len(texts)), windows)
    h = h[np.arange(len(part)) + part * (size - 1)]
    shift = _U(n.bit_length() + 1)
    top = _U(65) - shift
    held = np.sort(((part >> 1).astype(np.uint64) << top) | (h >> shift << _U(1)) | (part & 1).astype(np.uint64))
    held = held[np.r_[True, held[1:] != held[:-1]]]
    again = held[1:] >> _U(1) == held[:-1] >> _U(1)
    pair = (held >> top).astype(np.intp)
    common = np.bincount(pair[1:][again], minlength=n)
    return common, np.bincount(pair, minlength=n) - common


def _confirmed(pairs: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame:
    """Of pairs(a, b) those linked on their full sets, with near, their Jaccard index in millionths. texts: id, text binary, of all ids that occur."""

    def counts(ids: list[int], mine: list[bytes], others: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many shingles the two of each pair have in common, and in all."""
        common, union = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        usual = np.zeros(len(ids), dtype=bool)
        if scheme.unit == "chars":  # lines are compared many at once, but for long ones and those without a whole shingle
            both = [(x.decode("utf-8", "replace"), y.decode("utf-8", "replace")) for x, y in zip(mine, others, strict=True)]
            usual[:] = [scheme.size <= min(len(x), len(y)) and len(x) + len(y) <= _TOGETHER for x, y in both]
            at = np.flatnonzero(usual)
            for lo, hi in _groups([len(both[i][0]) + len(both[i][1]) for i in at], _TOGETHER):
                common[at[lo:hi]], union[at[lo:hi]] = _shared([x for i in at[lo:hi] for x in both[i]], scheme.size)
        last, held = None, None
        for i in np.flatnonzero(~usual):
            if last is None or ids[i] != ids[last]:
                last, held = i, scheme.shingles(mine[i])
            theirs = scheme.shingles(others[i])
            union[i] = len(np.union1d(held, theirs))
            common[i] = len(held) + len(theirs) - union[i]
        return common, union

    def run(batches):
        for piece, _ in slices(batches, "text_b"):
            a, b = piece.column(0), piece.column(1)
            common, union = counts(*(piece.column(i).to_pylist() for i in (0, 2, 3)))
            mask = pa.array(100 * common >= scheme.percent * union)
            near = pa.array(1_000_000 * common // np.maximum(1, union))
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask), near.filter(mask)], names=["a", "b", "near"])

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_a.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, near long")


def can_be_linked(a: str, b: str, signed: bool, scheme: Scheme) -> Column:
    """Whether sets of n_`a` and n_`b` shingles can be linked, by their sizes and by sign_`a` and sign_`b` if they have signs.

    A sign is the parity of a set's shingles at each of some hundred places. Signs of two sets differ at no more places than
    the sets have shingles that aren't in both, so no link is lost (Sandes, Teodoro and Melo, "Bitmap filter", 2020).
    """
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    can = F.greatest(n_a, n_b) * scheme.percent <= F.least(n_a, n_b) * 100
    if not signed:
        return can
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"sign_{a}")[i].bitwiseXOR(F.col(f"sign_{b}")[i])) for i in range(SIGN // 64)])
    return can & (differ * (100 + scheme.percent) <= (n_a + n_b) * (100 - scheme.percent))


def _plausible(pairs: DataFrame, regs: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs (a, b), once each, without those whose registers, if there are any, rule the link out."""

    def run(batches):
        for batch in batches:
            a, b, n_a, n_b, r_a, r_b = batch.columns
            keep = np.ones(batch.num_rows, dtype=bool)
            at = np.flatnonzero(np.asarray(r_a.is_valid()) & np.asarray(r_b.is_valid()))
            if len(at):
                m_a, m_b = (np.frombuffer(b"".join(r.take(pa.array(at)).to_pylist()), dtype=np.uint16).reshape(-1, scheme.registers) for r in (r_a, r_b))
                near = estimate(m_a, m_b, n_a.to_numpy()[at], n_b.to_numpy()[at])
                keep[at] = near >= scheme.percent / 100 - scheme.slack
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    once = pairs.select("a", "b").distinct()
    if "regs" not in regs.columns:
        return once
    both = once.join(regs.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("r_b")), "b")
    both = both.join(regs.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("r_a")), "a")
    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def _prefix_pairs(members: DataFrame, texts: DataFrame, scheme: Scheme, keep: Scratch) -> DataFrame:
    """(a, b) of members(id, n, c) of different components c, with all that can be linked. texts: id, text, and sign if there is one.

    A positional prefix join (Xiao et al., PPJoin, 2008). Shingles are put in one order, rare ones first.
    Linked sets share one of their first n - ceil(t n) + 1; and at the first that they share, no more can
    be common than what either set has from there on. Near copies of one text whose own changes already
    use up what a link allows so meet nobody, however many they are. Any order is exact as long as all
    sets keep it; rarity is read from 2**CELLS hashed counts, so that no shingle need be shuffled for it.
    Per shingle only members outside its commonest component meet the others.
    """
    spark = members.sparkSession
    sign = ["sign"] if "sign" in texts.columns else []
    own = keep.keep(members.join(texts, "id").select("id", "n", "c", "text", *sign), "members")

    def shingles_of(batch):
        return (scheme.shingles(t) for piece, _ in slices([batch], "text") for t in piece.column(3).to_pylist())

    known = spark.sparkContext.broadcast(_cell_counts(own, shingles_of))

    def prefixes(batches):
        for piece, _ in slices(batches, "text", 1 << 20):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, n, c, text in zip(*(x.to_pylist() for x in piece.columns[:4]), strict=True):
                key, at = _prefix(scheme.shingles(text), known.value, scheme)
                for column, x in zip(out, (key.view(np.int64), *(np.full(len(at), v) for v in (i, n, c)), at), strict=True):
                    column.append(x.astype(np.int64))
            row = np.repeat(np.arange(piece.num_rows), [len(x) for x in out[0]])
            signs = [piece.column(x).take(pa.array(row)) for x in sign]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in out), *signs], names=["key", "id", "n", "c", "at", *sign])

    first = own.mapInArrow(prefixes, "key long, id long, n long, c long, at long" + ", sign array<long>" * len(sign))
    first = keep.keep(first, "prefixes")
    counts = first.groupBy("key", "c").agg(F.count("*").alias("k"))
    main = counts.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("several")).where("several > 1").select("key", "main")
    mixed = first.join(main, "key")
    left = mixed.where("c <> main").select("key", *[F.col(x).alias(f"{x}_a") for x in ("id", "n", "c", "at", *sign)])
    right = mixed.select("key", "main", *[F.col(x).alias(f"{x}_b") for x in ("id", "n", "c", "at", *sign)])
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    can = (most * 100 >= (F.col("n_a") + F.col("n_b") - most) * scheme.percent) & can_be_linked("a", "b", bool(sign), scheme)
    met = left.join(right, "key").where((F.col("c_a") != F.col("c_b")) & ((F.col("c_b") == F.col("main")) | (F.col("id_a") < F.col("id_b"))) & can)
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def linked(found: DataFrame, sets: DataFrame, texts: DataFrame, scheme: Scheme, keep: Scratch) -> DataFrame:
    """(node, component) of every set that is linked to another; component is a node of it.

    found(key, id, hub, k): the members of all buckets of several, hub being the least of them, the same for all, and k 2 where
    the bucket has two members (that of the hub may be missing), more in others. sets(id, n, and regs or sign if there are any) and
    texts(id, text binary, and sign if there is one): those of found at least, a row each. The links are those of all pairs that share a bucket.
    """
    sign = ["sign"] if "sign" in sets.columns else []
    own = sets.select("id", *[F.col(x).alias(f"{x}_id") for x in ("n", *sign)])
    hubs = sets.select(F.col("id").alias("hub"), *[F.col(x).alias(f"{x}_hub") for x in ("n", *sign)])

    def with_can(rows: DataFrame) -> DataFrame:
        return rows.join(own, "id").join(hubs, "hub").withColumn("can", can_be_linked("id", "hub", bool(sign), scheme))

    links, tested, labels = [], [], None
    # a bucket of two is settled by its pair, which other bands often have too
    twos, several = found.where("k = 2 and id <> hub").select("id", "hub"), found.where("k > 2").select("key", "id", "hub")
    if sign:
        # so are buckets of few by theirs
        sizes = keep.keep(several.groupBy("key").agg(F.count("*").alias("m")), "sizes")
        few = several.join(sizes.where(F.col("m") <= FEW), "key")
        twos = twos.union(few.select("key", "id").join(few.select("key", F.col("id").alias("other")), "key").where("other < id").select("id", "other"))
        several = several.join(sizes.where(F.col("m") > FEW), "key", "left_semi")
    twos = with_can(twos.distinct()).where("can")
    live = keep.keep(with_can(several).select("key", "id", F.col("n_id").alias("n"), "hub", "can"), "live")

    def labelled(rows: DataFrame, label: str, of_hub: bool) -> DataFrame:
        """rows with the component c of each member and c_hub of its hub, without buckets of one component, not counting the hub's row unless of_hub."""
        marked = rows.drop("c", "c_hub").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        # it is read twice, so it is stored lest members meet their labels twice
        marked = keep.keep(marked, "marked")
        counted = F.col("c") if of_hub else F.when(F.col("id") != F.col("hub"), F.col("c"))
        mixed = marked.groupBy("key").agg(F.min(counted).alias("low"), F.max(counted).alias("high"), F.max(F.when(F.col("id") == F.col("hub"), F.col("c"))).alias("c_hub"))
        return keep.keep(marked.join(mixed.where("low < high").select("key", "c_hub"), "key"), label)

    def tried(pairs: DataFrame) -> None:
        nonlocal labels
        near = _plausible(pairs, sets, scheme)
        if tested:
            near = near.join(reduce(DataFrame.union, tested), ["a", "b"], "left_anti")
        tested.append(keep.keep(near, "pairs"))
        links.append(keep.keep(_confirmed(tested[-1], texts, scheme), "links"))
        labels = components(reduce(DataFrame.union, links), keep)

    # 1: buckets settled by their pairs, and each member with the least hub among its other buckets
    least = live.where("id <> hub and can").groupBy("id").agg(F.min("hub").alias("hub"))
    tried(least.select("hub", "id").union(twos.select("hub", "id")).toDF("a", "b"))
    # 2: each member with the hub of every bucket that still holds several components
    live = labelled(live, "rest2", True)
    tried(live.where("id <> hub and can and c <> c_hub").select(F.col("hub").alias("a"), F.col("id").alias("b")))
    # 3: each member with the one nearest to the hub, likely a middle of the bucket, where that is in another component.
    # From here on the hub has met all, so buckets whose other members are of one component are done with
    live = labelled(live, "middle", False)
    nearest = live.where("id <> hub").select("key", "id", "n", "c", F.col("hub").alias("a"), F.col("id").alias("b"))
    nearest = nearest.join(reduce(DataFrame.union, links), ["a", "b"]).groupBy("key").agg(F.max(F.struct("near", "id", "n", "c")).alias("m"))
    others = live.join(nearest, "key").where("c <> m.c").select("id", F.col("n").alias("n_id"), F.col("m.id").alias("mid"), F.col("m.n").alias("n_mid"))
    tried(others.where(can_be_linked("id", "mid", False, scheme)).select(F.least("id", "mid").alias("a"), F.greatest("id", "mid").alias("b")))
    # 4: whatever link is left lies between members of one bucket, neither its hub; an exact prefix join finds it
    live = labelled(live, "rest4", False)
    tried(_prefix_pairs(live.where("id <> hub").select("id", "n", "c").distinct(), texts, scheme, keep))
    return labels


def near_duplicates(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """A row for each row of docs(doc_id, text, ...): doc_id, n_shingles, component_id, kept, hash (text_hash of the text), first.

    kept: the row has its component's least doc_id. first: it has the least text hash of those too, so that of each
    component one text is first, also where a doc_id repeats with other texts.
    """
    keep = Scratch(docs.sparkSession)
    sk = keep.keep(sketches(docs, scheme), "sketch")
    # a node for each distinct set; the document that is first shows it
    sets = sk.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "hash")).alias("first"))
    sets = keep.keep(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    reps = sk.join(sets, "fp").where(F.struct("doc_id", "hash") == F.col("first")).dropDuplicates(["id"])
    reps = keep.keep(reps.select("id", "doc_id", "hash", "n", "keys", "regs", "small"), "reps")
    context = reps.sparkSession.sparkContext
    counts = context.broadcast(_cell_counts(reps.where("small is not null").select("small"), lambda b: _lists(b.column(0))))
    shared = _keys(reps, counts, scheme).groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("k")).where("k > 1")
    shared = keep.keep(shared, "shared")
    # most buckets have one member: these are sifted out before the buckets meet their hubs
    wanted = context.broadcast(bitmap(shared, "key"))
    found = keep.keep(_keys(reps, counts, scheme, wanted).join(shared, "key"), "buckets")
    some = keep.keep(sifted(reps.select("id", "doc_id", "hash", "n", "regs"), "id", bitmap(found, "id")), "registers")
    texts = sifted(_hashed(docs), "doc_id", bitmap(some, "doc_id")).join(some.select("id", "doc_id", "hash"), ["doc_id", "hash"])
    texts = keep.keep(texts.select("id", "text").dropDuplicates(["id"]), "texts")
    labels = linked(found, some.select("id", "n", "regs"), texts, scheme, keep)
    named = labels.withColumnRenamed("node", "id").join(sets, "id")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    of_set = sets.join(named.join(least, "component").select("id", "least"), "id", "left").select("fp", F.coalesce("least", "first").alias("least"))
    result = sk.select("doc_id", "hash", "n", "fp").join(of_set, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id")).alias("component_id")
    first = F.coalesce(F.struct("doc_id", "hash") == F.col("least"), F.lit(True)).alias("first")
    result = result.select("doc_id", F.col("n").alias("n_shingles"), component, "hash", first)
    result = checkpointed(result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
    keep.clear()
    return result.select("doc_id", "n_shingles", "component_id", "kept", "hash", "first")
