"""Preference formatting of conversations.

A pair is two conversations, chosen and rejected. Their longest common turn prefix is rendered once, as
the prompt; what follows is rendered as two masked completions. A row is a rendered turn:
pair_id, part (`prompt`, `chosen` or `rejected`), turn, nth, role, rendered, loss_start, loss_end.
The rows of a prompt and then of one completion, in order of turn and nth, are that training text. The
loss span counts characters of `rendered`, from 0: the words and end mark of an assistant turn in a
completion; it is null for all other turns.

Rows, not strings, leave here because one conversation may hold any share of all turns: nothing gathers
a conversation in one task. Both sides of a turn meet by (pair, turn), and the place at which a pair parts
is the least mismatch, a partial aggregate.

Defined results: turns are compared by role and text; null is a value of its own in the comparison and
renders as empty. A turn number with several different rows has them in order of role and text (nth);
rows repeated exactly count once. A null turn comes last. A pair with one side only has an empty prompt.
Marks inside texts are broken by a space, so that they can't end a turn. Texts are rendered whole, however long; empty ones as
turns without words. Turns that tie in number are told apart by nth. Columns other than the five of a turn don't matter. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAST = (1 << 63) - 1


def _rendered(role: Column, text: Column) -> Column:
    clean = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit("<|im_start|>"), clean(role), F.lit("\n"), clean(text), F.lit("<|im_end|>\n"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """turns(pair_id, rejected boolean, turn, role, text) as rendered rows."""
    rows = turns.select("pair_id", "rejected", F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("at"), "role", "text")
    # one exchange serves the ranks, the removal of repeated rows and the meeting of both sides
    rows = rows.repartition("pair_id", "at")
    same = W.partitionBy("pair_id", "at", "rejected").orderBy("role", "text")
    rows = rows.withColumn("nth", F.dense_rank().over(same) - 1).withColumn("row", F.row_number().over(same))
    first = F.row_number().over(W.partitionBy("pair_id", "at", "rejected", "nth").orderBy("row"))
    rows = rows.withColumn("copy", first).where("copy = 1")
    side = lambda flag: F.first(F.when(F.col("rejected") == flag, F.struct("role", "text")), ignorenulls=True)
    met = rows.groupBy("pair_id", "at", "nth").agg(side(False).alias("c"), side(True).alias("r"))
    equal = F.col("c").isNotNull() & F.col("r").isNotNull() & F.col("c.role").eqNullSafe(F.col("r.role")) & F.col("c.text").eqNullSafe(F.col("r.text"))
    parting = met.where(~equal).groupBy("pair_id").agg(F.min(F.struct("at", "nth")).alias("parting")).withColumnRenamed("pair_id", "__pair")
    met = met.join(parting, met["pair_id"].eqNullSafe(parting["__pair"]), "left")
    shared = F.col("parting").isNull() | (F.struct("at", "nth") < F.col("parting"))
    one = lambda part, c: F.struct(F.lit(part).alias("part"), F.col(f"{c}.role").alias("role"), F.col(f"{c}.text").alias("text"))
    sides = F.filter(F.array(F.when(F.col("c").isNotNull(), one("chosen", "c")), F.when(F.col("r").isNotNull(), one("rejected", "r"))), lambda x: x.isNotNull())
    out = met.select("pair_id", "at", "nth", F.explode(F.when(shared, F.array(one("prompt", "c"))).otherwise(sides)).alias("s"))
    out = out.select("pair_id", "s.part", F.when(F.col("at") < LAST, F.col("at")).alias("turn"), "nth", F.col("s.role").alias("role"), _rendered(F.col("s.role"), F.col("s.text")).alias("rendered"))
    trained = (F.col("part") != "prompt") & F.col("role").eqNullSafe("assistant")
    start = F.when(trained, F.lit(len("<|im_start|>assistant\n")))
    return out.withColumn("loss_start", start).withColumn("loss_end", F.when(trained, F.length("rendered") - 1))


def paired(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k+1 as chosen and rejected of pair k. A null conv_id is chosen of pair null."""
    conv = F.col("conv_id").cast("long")
    rejected = F.coalesce(F.pmod(conv, F.lit(2)) == 1, F.lit(False))
    return conversations.select(F.floor(conv / 2).cast("long").alias("pair_id"), rejected.alias("rejected"), "turn", "role", "text")
