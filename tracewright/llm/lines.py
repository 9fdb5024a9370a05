"""Fuzzy line deduplication over a corpus.

A line is normalised (lower case, runs of ASCII white space one space, trimmed). Equal lines are one;
different ones are linked when the Jaccard index of their sets of 8-character shingles is 0.8 or more. Of
each component of links one line stays: that of least (doc_id, place). Blank lines always stay.

Signatures. HyperMinHash registers of 2 layers of 32 buckets and 16 bands of 4 registers, as minhash.py
has them, are made for all lines of a piece of text at once. A line of Jaccard 0.8 shares a band with
probability 1 - (1 - 0.8**4)**16 = 0.9998, of 0.85 and more with 0.99999. Lines of at most `small` different
shingles take an exact way: two that are linked share one of their n - ceil(0.8 n) + 1 shingles of least hash.

Nearly no line has a partner, so no line is stored or shuffled. One pass over the texts ships a record of each
line, its hashes and place, by which exact copies are one; and its keys, 13 bytes each, by which a task finds
those that several lines have. A second pass fetches the few lines that have such a key.
Links are confirmed on whole lines and united as in minhash.py.

Hot lines and keys: copies within a piece are one line. A key goes out three times at most from a buffer of BUFFER
keys, however many lines of it have the key; the others go out as members of their bucket, to any task. The
joins that bring members to hubs and components back to documents are ones that Spark splits.

Defined results: null text has no line; empty text has one, blank. A null doc_id sorts first, so its
lines are kept before others. Rows that repeat a doc_id and its text keep the same lines; with other texts they are
documents of their own. A long line is hashed whole, in windows; a text is one Python object of a task. Of ties in place the least hash
of the text owns a line. Columns other than doc_id and text don't matter, and rebuilt() keeps them. An empty table gives no rows.

Lines are told apart by 128 bits. A line's node is its first 64; lines that share those with another, unlike line
(some thousands of pairs in 10**11 lines) have the other 64 for a node, and a pass of their own over the texts makes their keys again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import bitmap, passes, sifted
from .common import Scratch, checkpointed, slices
from .minhash import SIGN, Scheme, _mix, band_keys_of, least_of, linked, packed, rolled, text_hash

SCHEME = Scheme(size=8, unit="chars", layers=2, bits=5, small=24)
#: Code points that are hashed at once: what a core's cache holds. Longer lines are cut into overlapping parts for it.
WINDOW = 1 << 15
#: Keys of a buffer, and bytes of records and keys that one task sorts, about.
BUFFER, BYTES_A_TASK = 1 << 18, 32 << 20
_U = np.uint64
#: What is known of a line: hashes, and its least place: doc_id if there is one, the hash of that text, the number of the line.
_RECORD = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("has", "i1"), ("doc_id", "<i8"), ("place", "<i4"), ("hash", "<i8")])


#: White space other than single spaces between words.
_ODD = (b"  ", b"\t", b"\r", b"\x0b", b"\x0c")


def lines_in(text: bytes) -> list[bytes]:
    """The normalised lines of a UTF-8 text."""
    low = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode("utf-8", "replace")
    if any(x in low for x in _ODD):
        return [b" ".join(x.split()) for x in low.split(b"\n")]
    return [x.strip(b" ") for x in low.split(b"\n")]


def hashes(lines: list[bytes], bits: int = 64) -> np.ndarray:
    """int64[n, 2]: the 128 bits by which lines are told apart; of the first 64 all but `bits` are 0."""
    raw = b"".join([xxhash.xxh3_128_digest(x) for x in lines])
    found = np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)
    return found if bits == 64 else found & np.array([(1 << bits) - 1, -1])


def _texts(docs: DataFrame) -> DataFrame:
    own = docs.where("text is not null")
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("hash"), F.col("text").cast("binary").alias("text"))


def _windows(lines: list[str], size: int):
    """Groups of about WINDOW code points of the texts: the text of each window of `size` code points, and its hash."""
    held, length = [], 0

    def out():
        own = np.array([k for k, _ in held])
        windows = np.array([len(x) - size + 1 for _, x in held])
        h = rolled(np.frombuffer("".join([x for _, x in held]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), size)
        part = np.repeat(np.arange(len(held)), windows)
        return np.repeat(own, windows), h[np.arange(len(part)) + part * (size - 1)]

    for k, x in enumerate(lines):
        for i in range(0, len(x) - size + 1, WINDOW):
            part = x[i : i + WINDOW + size - 1]
            if held and length + len(part) > WINDOW:
                yield out()
                held, length = [], 0
            held.append((k, part))
            length += len(part)
    if held:
        yield out()


def signed(lines: list[str], scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """The registers of lines that have as many code points as a shingle at least, and whether each may have
    at most `small` different shingles: one of the first small + 1 repeats."""
    least = np.full((len(lines), scheme.registers), 0xFFFFFFFF, dtype=np.uint32)
    few = np.zeros(len(lines), dtype=bool)
    first = scheme.small + 1
    for own, h in _windows(lines, scheme.size):
        lo, hi = own[0], own[-1] + 1
        least[lo:hi] = np.minimum(least[lo:hi], least_of(h, own - lo, hi - lo, scheme))
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        enough = np.diff(np.r_[starts, len(own)]) >= first
        ahead = np.sort(h[starts[enough][:, None] + np.arange(first)], axis=1)
        few[own[starts[enough]]] |= (ahead[:, 1:] == ahead[:, :-1]).any(axis=1)
        few[own[starts[~enough]]] = True
    return packed(least, scheme), few


def _small_keys(lines: list[bytes], scheme: Scheme) -> list[np.ndarray]:
    """The keys of the exact way of each line; none for lines of more than `small` shingles."""
    out = []
    for x in lines:
        held = scheme.shingles(x)
        key = held[: len(held) - scheme.least(len(held)) + 1] if len(held) <= scheme.small else held[:0]
        out.append(_mix(key ^ _U(0x5851F42D4C957F2D)).view(np.int64))
    return out


def _keys(lines: list[bytes], own: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """All keys of different lines, and the line's h1 of each."""
    least = scheme.least(scheme.small + 1) + scheme.size - 1
    texts = [x.decode() for x in lines]
    long = np.fromiter(map(len, texts), dtype=np.int64, count=len(lines)) >= least
    regs, few = signed([texts[i] for i in np.flatnonzero(long)], scheme)
    keys, filled = band_keys_of(regs, scheme)
    short = np.r_[np.flatnonzero(~long), np.flatnonzero(long)[few]]
    exact = _small_keys([lines[i] for i in short], scheme)
    return np.concatenate([keys[filled], *exact]), np.concatenate([np.repeat(own[long], filled.sum(1)), np.repeat(own[short], [len(k) for k in exact]).astype(np.int64)])


#: Bits of a key besides the part it is dealt to.
_LOW = 40


def _dealt(keys: np.ndarray, parts: int) -> np.ndarray:
    """Keys by the part they are dealt to and _LOW bits. Different keys that become one make a bucket of lines that are then told apart."""
    x = keys.view(np.uint64)
    return (_mix(x) % _U(parts) << _U(_LOW) | x & _U((1 << _LOW) - 1)).view(np.int64)


#: What is shipped of a key and its line; the part is known where it arrives.
_PAIR = np.dtype([("key", "u1", _LOW // 8), ("h1", "<i8")])


def _paired(key: np.ndarray, own: np.ndarray) -> np.ndarray:
    out = np.empty(len(key), dtype=_PAIR)
    out["key"] = np.ascontiguousarray(key, dtype="<i8").view(np.uint8).reshape(-1, 8)[:, : _LOW // 8]
    out["h1"] = own
    return out


def _unpaired(data: bytes, part: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(data, dtype=_PAIR)
    key = np.zeros((len(pairs), 8), dtype=np.uint8)
    key[:, : _LOW // 8] = pairs["key"]
    return key.view("<i8")[:, 0] | np.int64(part << _LOW), pairs["h1"]


def _runs(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, dtype=np.intp)


def _least_records(records: np.ndarray) -> np.ndarray:
    """One record of each line, that of least place, in order of h1."""
    records = records[np.lexsort([records[c] for c in ("hash", "place", "doc_id", "has", "h2", "h1")])]
    return records[np.flatnonzero(np.r_[True, (records["h1"][1:] != records["h1"][:-1]) | (records["h2"][1:] != records["h2"][:-1])])] if len(records) else records


def _buckets(key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (key, own) in order, each once, with the place of its key's run and the starts of the runs."""
    order = np.argsort(key)
    key, own = key[order], own[order]
    starts = _runs(key)
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)]))
    if len(starts) < len(key):  # most keys are alone, so only the others need an order
        several = np.flatnonzero(np.bincount(run)[run] > 1)
        inner = several[np.lexsort((own[several], run[several]))]
        own[several] = own[inner]
    keep = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])] if len(key) else np.empty(0, dtype=bool)
    key, own = key[keep], own[keep]
    starts = _runs(key)
    return key, own, np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)])), starts


#: Kinds of blocks: records of lines; of blank lines, and one for each row with minus the number of its lines as place;
#: _PAIRs; and pairs (key, h1) that are known to be in a bucket of several.
LINES, PAIRS, MEMBERS, BLANKS = 0, 1, 2, 3
_REDUCED = "h1 long, h2 long, has boolean, doc_id long, place int, hash long, clash boolean, key long, id long, hub long, k int"


def _shipped(docs: DataFrame, scheme: Scheme, parts: int, bits: int) -> DataFrame:
    """part, kind, data: blocks of the records and keys of all lines, dealt to parts by h1 or key."""

    def blocks(kind: int, by: np.ndarray, rows: np.ndarray):
        part = by.view(np.uint64) >> _U(_LOW) if kind == PAIRS else _mix(by.view(np.uint64)) % _U(parts)
        order = np.argsort(part, kind="stable")
        rows, ends = rows[order], np.searchsorted(part[order], np.arange(parts + 1).astype(np.uint64))
        there = np.flatnonzero(np.diff(ends))
        for at in range(0, len(there), 1000):
            some = there[at : at + 1000]
            data = [rows[ends[i] : ends[i + 1]].tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([kind] * len(some), pa.int32()), pa.array(data, pa.binary())], names=["part", "kind", "data"])

    def put_out(records, blanks, keys, owners):
        blanks = np.concatenate(blanks)
        yield from blocks(BLANKS, np.ascontiguousarray(blanks["hash"]), blanks)
        records = _least_records(np.concatenate(records))
        yield from blocks(LINES, np.ascontiguousarray(records["h1"]), records)
        key, own, run, starts = _buckets(_dealt(np.concatenate(keys), parts), np.concatenate(owners))
        ends = np.r_[starts[1:], len(key)][: len(starts)] - 1
        # of each key its least and its greatest line meet others; those between are members at any rate, and the first of
        # them goes along, so that the key is seen to have more than two
        outer = np.zeros(len(key), dtype=bool)
        outer[starts] = outer[ends] = True
        outer[starts[ends > starts + 1] + 1] = True
        yield from blocks(PAIRS, key[outer], _paired(key[outer], own[outer]))
        yield from blocks(MEMBERS, own[~outer], np.stack([key[~outer], own[~outer]], axis=1))

    def run(batches):
        records, blanks, keys, owners, size = [], [], [], [], 0
        for piece, _ in slices(batches, "text"):
            found = [lines_in(text) for text in piece.column(2).to_pylist()]
            lines = [x for own in found for x in own]
            n = np.array([len(x) for x in found])
            h = hashes(lines, bits)
            full = np.fromiter(map(bool, lines), dtype=bool, count=len(lines))
            record = np.zeros(len(lines), dtype=_RECORD)
            doc = piece.column(0)
            record["h1"], record["h2"] = h.T
            record["has"] = np.repeat(np.asarray(doc.is_valid()), n)
            record["doc_id"] = np.repeat(doc.fill_null(0).to_numpy(), n)
            record["hash"] = np.repeat(piece.column(1).to_numpy(), n)
            record["place"] = np.arange(len(lines)) - np.repeat(np.cumsum(n) - n, n)
            records.append(record[full])
            ends = np.cumsum(n) - 1
            counts = record[ends]
            counts["place"] = -n
            blanks += [record[~full], counts]
            at = dict(zip(lines, range(len(lines)), strict=True))
            at.pop(b"", None)
            key, own = _keys(list(at), h[list(at.values()), 0], scheme)
            keys.append(key)
            owners.append(own)
            size += len(key) + len(lines)
            if size > BUFFER:
                yield from put_out(records, blanks, keys, owners)
                records, blanks, keys, owners, size = [], [], [], [], 0
        if records:
            yield from put_out(records, blanks, keys, owners)

    return _texts(docs).mapInArrow(run, "part int, kind int, data binary")


def _reduced(blocks: DataFrame) -> DataFrame:
    """The different lines, with clash where others share their h1 (key is null); blank lines and numbers of lines (h1 and
    key are null); the buckets of several lines: key, id (an h1), hub, the least of them, and k, 2 where the key has two lines
    (then the hub has no row) or more; hub and k are null for those members of whom only that is known."""
    names = [x.split()[0] for x in _REDUCED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def batches_of(columns: dict, n: int):
        for at in range(0, n, 1 << 18):
            yield pa.RecordBatch.from_arrays([columns[c][at : at + (1 << 18)] if c in columns else pa.nulls(min(n - at, 1 << 18), k) for c, k in zip(names, kinds, strict=True)], names=names)

    def run(batches):
        records, pairs = [], [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))]

        def placed(records):
            columns = {c: pa.array(np.ascontiguousarray(records[c])) for c in ("place", "hash")}
            return columns | {"has": pa.array(records["has"].astype(bool)), "doc_id": pa.array(np.ascontiguousarray(records["doc_id"]), mask=records["has"] == 0)}

        for b in batches:
            for part, kind, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if kind == MEMBERS:
                    key, own = np.frombuffer(data, dtype=np.int64).reshape(-1, 2).T
                    yield from batches_of({"key": pa.array(key), "id": pa.array(own)}, len(key))
                elif kind == BLANKS:
                    blanks = np.frombuffer(data, dtype=_RECORD)
                    yield from batches_of(placed(blanks), len(blanks))
                elif kind == PAIRS:
                    pairs.append(_unpaired(data, part))
                else:
                    records.append(data)
        records = _least_records(np.frombuffer(b"".join(records), dtype=_RECORD))
        if len(records):
            h1 = records["h1"]
            same = h1[1:] == h1[:-1]
            own = {"h1": pa.array(np.ascontiguousarray(h1)), "h2": pa.array(np.ascontiguousarray(records["h2"])), "clash": pa.array(np.r_[False, same] | np.r_[same, False])}
            yield from batches_of(placed(records) | own, len(records))
        key, own, run_, starts = _buckets(*map(np.concatenate, zip(*pairs, strict=True)))
        if len(key):
            k, hub = np.bincount(run_)[run_], own[starts][run_]
            there = (k > 2) | ((k == 2) & (own != hub))
            bucket = {"key": key[there], "id": own[there], "hub": hub[there], "k": k[there].astype(np.int32)}
            yield from batches_of({c: pa.array(x) for c, x in bucket.items()}, int(there.sum()))

    return blocks.select("part", "kind", "data").mapInArrow(run, _REDUCED)


_SIGNED = "id long, n long, sign array<long>, text binary"


def _signed_columns(lines: list[bytes], scheme: Scheme) -> list[pa.Array]:
    """n, sign, text of lines, as _SIGNED has them."""
    n, sign = signs(lines, scheme)
    width = SIGN // 64
    return [pa.array(n), pa.ListArray.from_arrays(np.arange(0, len(lines) * width + 1, width, dtype=np.int32), sign.ravel()), pa.array(lines, pa.binary())]


def _fetched(docs: DataFrame, wanted, scheme: Scheme, bits: int) -> DataFrame:
    """id, n, sign, text of the lines whose h1 passes the bitmap, one of each id: signs are made once, of copies too."""

    def run(batches):
        for piece, _ in slices(batches, "text"):
            lines = dict.fromkeys(x for text in piece.column(2).to_pylist() for x in lines_in(text))
            lines.pop(b"", None)
            found = list(lines)
            own = hashes(found, bits)[:, 0]
            mask = passes(wanted.value, own)
            yield pa.RecordBatch.from_arrays([pa.array(own[mask]), pa.array([found[i] for i in np.flatnonzero(mask)], pa.binary())], names=["id", "text"])

    def sign(batches):
        for piece, _ in slices(batches, "text"):
            columns = _signed_columns(piece.column(1).to_pylist(), scheme)
            yield pa.RecordBatch.from_arrays([piece.column(0), *columns], names=["id", "n", "sign", "text"])

    return _texts(docs).mapInArrow(run, "id long, text binary").dropDuplicates(["id"]).mapInArrow(sign, _SIGNED)


def _parity(places: np.ndarray, n: int) -> np.ndarray:
    """int64[n, SIGN // 64]: the bits that occur an odd number of times in places, SIGN of them for each of n."""
    odd = (np.bincount(places, minlength=n * SIGN) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, SIGN), axis=1).view(np.int64)


def signs(lines: list[bytes], scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """How many different shingles each line has; and its sign (minhash.can_be_linked), of zeros if it is shorter than a shingle."""
    texts = [x.decode() for x in lines]
    n, sign = np.ones(len(lines), dtype=np.int64), np.zeros((len(lines), SIGN // 64), dtype=np.int64)
    usual = np.array([k for k, x in enumerate(texts) if scheme.size <= len(x) <= WINDOW], dtype=np.intp)
    # lines in several windows are taken one by one
    apart = [k for k, x in enumerate(texts) if len(x) > WINDOW]
    top = _U(64 - SIGN.bit_length() + 1)
    for own, h in _windows([texts[k] for k in usual], scheme.size):
        at = own - own[0]
        some = usual[own[0] : own[-1] + 1]
        # shingles of a line that repeat are one; they are told by their hashes without the bits that the number of lines takes
        shift = _U(len(some).bit_length())
        held = np.sort((at.astype(np.uint64) << (_U(64) - shift)) | (h >> shift))
        held = held[np.r_[True, held[1:] != held[:-1]]]
        at = (held >> (_U(64) - shift)).astype(np.intp)
        n[some] = np.bincount(at)
        sign[some] = _parity(at * SIGN + (held << shift >> top).astype(np.intp), len(some))
    for k in apart:
        held = scheme.shingles(lines[k])
        n[k], sign[k] = len(held), _parity((held >> top).astype(np.intp), 1)[0]
    return n, sign


def _keyed_again(docs: DataFrame, wanted, scheme: Scheme, parts: int, bits: int) -> DataFrame:
    """h1, id (the other 64 bits), n, sign, text, keys of the lines whose h1 passes the bitmap; repeats within a piece are one."""

    def run(batches):
        for piece, _ in slices(batches, "text"):
            lines = dict.fromkeys(x for text in piece.column(2).to_pylist() for x in lines_in(text))
            lines.pop(b"", None)
            found = list(lines)
            own = hashes(found, bits)
            mask = passes(wanted.value, np.ascontiguousarray(own[:, 0]))
            texts, own = [found[i] for i in np.flatnonzero(mask)], own[mask]
            keys = [np.unique(_dealt(_keys([x], own[i : i + 1, 0], scheme)[0], parts)) for i, x in enumerate(texts)]
            columns = pa.array(own[:, 0]), pa.array(own[:, 1]), *_signed_columns(texts, scheme), pa.array(keys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns), names=["h1", "id", "n", "sign", "text", "keys"])

    return _texts(docs).mapInArrow(run, f"h1 long, {_SIGNED}, keys array<long>")


def components_of(docs: DataFrame, clash: DataFrame, members: DataFrame, scheme: Scheme, keep: Scratch, parts: int, bits: int) -> DataFrame:
    """(node, component) of the lines that are linked to others; clash(id): each h1 of several lines."""
    context = docs.sparkSession.sparkContext
    found, inner = members.where("hub is not null"), members.where("hub is null")
    hubs = found.where("k > 2").groupBy("key").agg(F.min("hub").alias("hub"), F.max("k").alias("k"))
    buckets = found.select("key", "id", "hub", "k").union(inner.select("key", "id").distinct().join(hubs, "key").select("key", "id", "hub", "k"))
    again = None
    if not clash.isEmpty():
        again = _keyed_again(docs, context.broadcast(bitmap(clash, "id")), scheme, parts, bits).join(clash.withColumnRenamed("id", "h1"), "h1", "left_semi")
        again = keep.keep(again.dropDuplicates(["id"]), "again")
        # the members hold all other lines of these keys: a key of lines of two h1s is one of several
        each = buckets.select("key", "id").union(found.where("k = 2").select("key", F.col("hub").alias("id")))
        buckets = each.join(clash, "id", "left_anti").select("key", "id").union(again.select(F.explode("keys").alias("key"), "id"))
        hubs = buckets.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").cast("int").alias("k")).where("k > 1")
        buckets = buckets.join(hubs, "key").select("key", "id", "hub", "k")
    buckets = keep.keep(buckets, "buckets")
    every = buckets.select("id").union(buckets.where("k = 2").select("hub"))
    sets = _fetched(docs, context.broadcast(bitmap(every, "id")), scheme, bits)
    if again is not None:
        # what else the bitmap lets through under a clashing h1 is in no bucket
        sets = sets.join(clash, "id", "left_anti").union(again.select("id", "n", "sign", "text"))
    sets = keep.keep(sets, "sets")
    return linked(buckets, sets.select("id", "n", "sign"), sets.select("id", "sign", "text"), scheme, keep)


def dedup_lines(docs: DataFrame, scheme: Scheme = SCHEME, bits: int = 64) -> DataFrame:
    """doc_id, hash (text_hash of the text), n_lines, kept, rows: the places of the lines that stay, from 0, in order; a row
    for each different (doc_id, text) that isn't null, and how many rows of docs(doc_id, text) have it. By `bits` bits lines
    are known until several share them; no number of them changes the result."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # a line of 100 bytes or more has 16 keys, 16 bytes each while they are sorted, and a record of 37
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-3 * size // BYTES_A_TASK))
    with Scratch(spark) as keep:
        parts = 4 * tasks
        found = keep.keep(_reduced(_shipped(docs, scheme, parts, bits).repartition(tasks, "part")), "lines")
        clash = found.where("clash").select(F.col("h1").alias("id")).distinct()
        node = F.when(F.col("clash"), F.col("h2")).otherwise(F.col("h1")).alias("h1")
        spot = ["has", "doc_id", "place", "hash"]
        lines = found.where("h1 is not null").select(node, *spot)
        members = found.where("key is not null").select("key", "id", "hub", "k")
        labels = components_of(docs, clash, members, scheme, keep, parts, bits).withColumnRenamed("node", "h1")
        labels = keep.keep(labels, "labels")
        in_parts = bitmap(labels, "h1")
        # the bitmap lets a few others through, which are told by the labels
        near = keep.keep(sifted(lines, "h1", in_parts), "near")
        mapped = near.join(labels, "h1")
        owners = mapped.groupBy("component").agg(F.min(F.struct(*spot)).alias("o")).select("o.*")
        alone = _unlike(lines, in_parts).union(near.join(labels.select("h1"), "h1", "left_anti").select(*lines.columns))
        blanks = found.where("h1 is null and key is null").select(*spot)
        stay = alone.select(*spot).union(owners.select(*spot)).union(blanks)
        mine = F.collect_list(F.when(F.col("place") >= 0, F.col("place")))
        out = stay.groupBy("doc_id", "hash").agg((-F.min("place")).alias("n_lines"), F.array_sort(mine).alias("kept"), F.count_if(F.col("place") < 0).alias("rows"))
        # a blank line comes once for each row that has it
        return checkpointed(out.withColumn("kept", F.array_distinct("kept")))


def _unlike(lines: DataFrame, in_parts: np.ndarray) -> DataFrame:
    """The lines that the bitmap doesn't let through."""
    known = lines.sparkSession.sparkContext.broadcast(in_parts)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(~passes(known.value, b.column(0).to_numpy())))

    return lines.mapInArrow(run, lines.schema)


def rebuilt(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs, all columns, their text without the lines that go."""
    own = "_" * (1 + max(map(len, docs.columns)))  # no column of docs begins so
    kept = decided.select(*[F.col(c).alias(own + c) for c in ("doc_id", "hash", "kept")])
    out = docs.join(kept, docs["doc_id"].eqNullSafe(F.col(own + "doc_id")) & (text_hash(docs["text"]) == F.col(own + "hash")), "left")
    lines = F.filter(F.split("text", "\n"), lambda x, i: F.array_contains(own + "kept", i))
    return out.withColumn("text", F.array_join(lines, "\n")).select(*docs.columns)
