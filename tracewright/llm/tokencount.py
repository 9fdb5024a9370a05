"""Tokens of whole texts under a BPE piece model, counted by distinct pre-token.

Method. A piece model merges two neighbours only where the merged string is a piece, so a place between two characters
that stand side by side in no piece is never crossed: what lies between such places (a pre-token) is merged by itself, and
counts add up. The cuts come from the vocabulary in hand (`Pieces`), not from a rule about languages. Texts fall into
chunks at their spaces, and a chunk met before is not cut again. Pre-tokens are summed over all texts, each distinct one is encoded once, and a document's frequencies meet these counts: for the at most
MOST_SHIPPED commonest ones in a dictionary that is broadcast, for all others in a shuffled join, where none is a hot key, as
the common ones are not there. Ids are never kept: of an encoding only its length is read.

Defined results:
- null and empty texts: no tokens; 0 bytes for null.
- long texts: read whole. Only what holds no cut for over LONGEST characters is encoded where it stands rather than as a
  key; the library holds such a run whole.
- special strings (`<s>`, `<0x0A>`) are ordinary text, as the library takes them; U+2581 is a space, as in the library.
- ties: counts have none. Repeated rows and doc_ids, and null doc_ids: each row has its own result.
- empty table: no rows.
- extra columns: come back as they are; columns named n_bytes, n_tokens and over_limit are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, slices

SPACE = "▁"

#: Longer pre-tokens, in characters, are encoded where they stand.
LONGEST = 256

#: Bounds of the broadcast dictionary, in entries and in characters an entry.
MOST_SHIPPED, LONGEST_SHIPPED = 1 << 18, 64

#: Distinct chunks that a task holds before it passes their sums on, or forgets them.
HELD = 1 << 17


class Pieces:
    """A piece model: its pre-tokens, and the tokens of one.

    The model must be BPE with byte fallback, without changes to the text (identity normaliser, white space kept) and without
    pieces that are matched ahead of merges; with any other the counts of pre-tokens need not add up, and it is refused.
    """

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("counting by pre-token needs a BPE model with byte fallback and spaces before words")
        if plain.precompiled_charsmap or plain.remove_extra_whitespaces or not plain.add_dummy_prefix or not plain.escape_whitespaces:
            raise ValueError("counting by pre-token needs a model that leaves texts as they are")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("counting by pre-token needs a model of normal pieces only")
        plain.add_dummy_prefix = False  # pre_tokens() puts the space before a text, and only there
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.leads, pattern = _pattern(p.piece for p in proto.pieces if p.type == kinds.NORMAL)
        self.fine, self.runs = re.compile(pattern, re.DOTALL), re.compile(" +[^ ]*")

    def chunks(self, text: str | None) -> list[str]:
        """A text, with the space that the model puts before it, cut before its spaces; each chunk without its first space.

        Cheap, and most chunks have been met before.
        """
        if not text:
            return []
        if not self.leads:
            return [text]
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in self.runs.findall(" " + text)]
        return text.split(" ")

    def pre_tokens(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk in order; joined they are the chunk as the model sees it."""
        return self.fine.findall(SPACE + chunk.replace(" ", SPACE))

    def tokens(self, pre_tokens: list[str]) -> list[int]:
        """The number of tokens of each pre-token."""
        return [len(ids) for ids in self.library.encode(pre_tokens, num_threads=1)]


def _pattern(pieces: Iterable[str]) -> tuple[bool, str]:
    """Whether spaces only lead pieces; and pre-tokens: spaces with a run of characters that are linked by standing side by
    side in a piece, or with one other character. Where a piece has a space after another character, a chunk is the whole
    text and spaces are characters like all others.
    """
    beside = {(a, b) for piece in pieces for a, b in zip(piece, piece[1:], strict=False)}
    leads = not any(b == SPACE != a for a, b in beside)
    above: dict[str, str] = {}

    def top(c: str) -> str:
        while above.setdefault(c, c) != c:
            above[c] = above[above[c]]
            c = above[c]
        return c

    for a, b in beside:
        if not (leads and a == SPACE):
            above[top(a)] = top(b)
    groups: dict[str, list[str]] = {}
    for c in sorted(above):
        groups.setdefault(top(c), []).append(c)
    runs = [f"[{''.join(map(re.escape, g))}]+" for g in sorted(groups.values(), key=len, reverse=True)]
    body = "|".join([*runs, f"[^{SPACE}]" if leads else "."])
    return leads, f"{SPACE}*(?:{body})|{SPACE}+" if leads else body


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> Pieces:
    return Pieces(model)


def counted(docs: DataFrame, model: bytes, scratch: Scratch, limit: int = 4096, keep_text: bool = True, most_shipped: int = MOST_SHIPPED) -> DataFrame:
    """docs(text, ...) with n_bytes long, n_tokens long and over_limit boolean (n_tokens > limit) added; without text if so told.

    `model` is the content of the model's file; it is broadcast (0.5 MB for 32,000 pieces), so executors need no file.
    The result reads tables of `scratch`.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    shipped = spark.sparkContext.broadcast(model)
    counts = scratch.keep(token_counts(docs, shipped), "pretokens")
    known = spark.sparkContext.broadcast(_commonest(counts, most_shipped))
    parts = scratch.keep(_known_and_rare(docs, shipped, known, keep_text), "frequencies")
    rare = parts.where("size(__rare) > 0").select("__row", F.explode("__rare").alias("__r")).select("__row", F.col("__r.token").alias("token"), F.col("__r.n").alias("times"))
    rest = rare.join(counts.select("token", "pieces"), "token").groupBy("__row").agg(F.sum(F.col("times") * F.col("pieces")).alias("__rest"))
    total = F.col("__known") + F.coalesce("__rest", F.lit(0).cast("long"))
    out = parts.join(rest, "__row", "left").withColumn("n_tokens", total)
    return out.select(*[c for c in docs.columns if keep_text or c != "text"], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def token_counts(docs: DataFrame, shipped) -> DataFrame:
    """token string, n long (times in all texts), pieces int: a row for each distinct pre-token of LONGEST characters at most."""

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = _loaded(shipped.value), Counter()
        for piece, _ in slices(batches, "text"):
            for text in piece.column(0).to_pylist():
                held.update(pieces.chunks(text))
                if len(held) > HELD:
                    yield _sums(pieces, held)
                    held.clear()
        if held:
            yield _sums(pieces, held)

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(shipped.value)
        for piece, _ in slices(batches, "token"):
            n = pieces.tokens(piece.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(n, pa.int32())], names=["token", "n", "pieces"])

    tokens = docs.select("text").mapInArrow(summed, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return tokens.mapInArrow(encoded, "token string, n long, pieces int")


def _sums(pieces: Pieces, held: Counter) -> pa.RecordBatch:
    """Of chunks the sums of their pre-tokens, without the overlong ones."""
    sums: dict[str, int] = {}
    for chunk, n in held.items():
        for token in pieces.pre_tokens(chunk):
            if len(token) <= LONGEST:
                sums[token] = sums.get(token, 0) + n
    return pa.RecordBatch.from_arrays([pa.array(sums, pa.string()), pa.array(sums.values(), pa.int64())], names=["token", "n"])


def _commonest(counts: DataFrame, most: int) -> dict[str, int]:
    """Pieces of the commonest pre-tokens: all that come 2**e times or more, for the least e that leaves `most` at most."""
    short = counts.where(F.length("token") <= LONGEST_SHIPPED)
    exponent = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    sizes = {r["e"]: r["c"] for r in short.groupBy(exponent.alias("e")).agg(F.count("*").alias("c")).collect()}
    least, taken = None, 0
    for e in sorted(sizes, reverse=True):
        taken += sizes[e]
        if taken > most:
            break
        least = e
    if least is None:
        return {}
    return {r["token"]: r["pieces"] for r in short.where(exponent >= least).select("token", "pieces").toLocalIterator()}


def _known_and_rare(docs: DataFrame, shipped, known, keep_text: bool) -> DataFrame:
    """docs with n_bytes, the tokens of its common and of its overlong pre-tokens, and the frequencies of all others."""
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    rare_type = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, common = _loaded(shipped.value), known.value
        met: dict[str, tuple[int, list[str]]] = {}  # of a chunk: the tokens of its common and overlong pre-tokens, and the others
        row = TaskContext.get().partitionId() << 33

        def looked_up(chunk: str) -> tuple[int, list[str]]:
            total, rare = 0, []
            for token in pieces.pre_tokens(chunk):
                found = common.get(token)
                if found is not None:
                    total += found
                elif len(token) > LONGEST:
                    total += pieces.tokens([token])[0]
                else:
                    rare.append(token)
            if len(chunk) <= LONGEST:
                if len(met) > HELD:
                    met.clear()
                met[chunk] = total, rare
            return total, rare

        for piece, _ in slices(batches, "text"):
            text = piece.column(piece.schema.get_field_index("text"))
            sums, rares = [], []
            for t in text.to_pylist():
                total, rare = 0, Counter()
                for chunk, n in Counter(pieces.chunks(t)).items():
                    found, others = met.get(chunk) or looked_up(chunk)
                    total += n * found
                    for token in others:
                        rare[token] += n
                sums.append(total)
                rares.append([{"token": token, "n": n} for token, n in rare.items()])
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(text), 0).cast(pa.int64())
            rows = pa.array(range(row, row + len(piece)), pa.int64())
            row += len(piece)
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(piece.schema.get_field_index(f.name)) for f in kept), n_bytes, rows, pa.array(sums, pa.int64()), pa.array(rares, rare_type)],
                names=[*(f.name for f in kept), "n_bytes", "__row", "__known", "__rare"],
            )

    rare_sql = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("n", T.LongType())]))
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("__row", T.LongType()), T.StructField("__known", T.LongType()), T.StructField("__rare", rare_sql)]
    return docs.mapInArrow(run, T.StructType([*kept, *added]))
