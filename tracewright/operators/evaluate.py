"""Execution and scoring of predicted against gold SQL."""

from __future__ import annotations

import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dialect
from ..functions import sqltext as X
from ..functions.vocabulary import Vocabulary
from .digest import Digest, Key, digest
from .order import numbered_in_place

TIMEOUT = 5.0
HEAD = 5


@dataclass
class Execution:
    """The outcome of one statement: the digest of its whole result, or an error as data.

    `rows` is the result as normal rows, not kept: reading it runs the statement again.
    """

    ok: bool
    rows: DataFrame | None = None
    columns: tuple[str, ...] = ()
    digest: Digest = field(default_factory=Digest)
    error: str | None = None
    elapsed_ms: int = 0

    @property
    def count(self) -> int:
        return self.digest.count


_PLANS = "org.apache.spark.sql.catalyst.plans.logical."


def only_reads(spark: SparkSession, sql: str) -> bool:
    """Whether no node of the parsed plan is a command or a statement that writes, wherever it stands, as behind a WITH."""
    gateway = spark.sparkContext._gateway
    left = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while left:
        node = left.pop()
        if any(is_instance_of(gateway, node, _PLANS + kind) for kind in ("Command", "ParsedStatement", "InsertIntoDir")):
            return False
        for inner in (node.children(), node.innerChildren()):
            left += [x for x in (inner.apply(i) for i in range(inner.size())) if is_instance_of(gateway, x, _PLANS + "LogicalPlan")]
    return True


class Executor:
    """Runs one query statement at a time against the views of a session; nothing else is let through."""

    def __init__(self, spark: SparkSession, timeout: float = TIMEOUT, sqlite: bool = True, known: Vocabulary | None = None):
        self.spark, self.timeout, self.sqlite, self.known = spark, timeout, sqlite, known
        self.key = Key.drawn()

    def execute(self, sql: str | None) -> Execution:
        start = time.monotonic()
        took = lambda: int((time.monotonic() - start) * 1000)
        if not (sql or "").strip().strip(";"):
            return Execution(False, error="empty SQL")
        if not dialect.is_query(sql):
            return Execution(False, error="not a single query statement")
        context, group = self.spark.sparkContext, f"execution-{uuid.uuid4().hex}"
        late = threading.Event()

        def stop():
            late.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(self.timeout, stop)
        context.setJobGroup(group, sql[:100], interruptOnCancel=True)
        timer.start()
        try:
            text = dialect.to_spark(sql, known=self.known) if self.sqlite else sql.rstrip("; \n")
            if not only_reads(self.spark, text):
                return Execution(False, error="not a single query statement", elapsed_ms=took())
            rows = self.spark.sql(text)
            cells = normal_rows(rows)
            return Execution(True, cells, tuple(rows.columns), digest(cells, self.key, HEAD), elapsed_ms=took())
        except Exception as e:
            error = f"timeout after {self.timeout:g} s" if late.is_set() else f"{type(e).__name__}: {str(e).splitlines()[0]}"
            return Execution(False, error=error, elapsed_ms=took())
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)


def normal_cell(c: Column, kind: T.DataType) -> Column:
    """A cell as text: null is <null>, a whole float its integer, other floats 6 digits, booleans 1 or 0, else trimmed lower case.

    Infinite floats and NaN are inf, -inf and nan; minus zero is 0.
    """
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = c.cast("double") + F.lit(0.0)  # minus zero becomes zero
        large = F.lit(float("inf"))
        odd = F.when(F.isnan(d), "nan").when(d == large, "inf").when(d == -large, "-inf")
        text = F.when(d.isNotNull(), odd.otherwise(F.when(d == F.rint(d), F.format_string("%.0f", d)).otherwise(F.format_string("%.6f", d))))
    elif isinstance(kind, T.BooleanType):
        text = F.when(c, "1").otherwise("0")
    elif isinstance(kind, T.StringType):
        text = F.lower(F.trim(c))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.lower(F.to_json(c))
    else:
        text = F.lower(F.trim(c.cast("string")))
    return F.coalesce(text, F.lit("<null>"))


def normal_rows(df: DataFrame) -> DataFrame:
    """row array<string> and place, the order in which the rows came."""
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    cells = [normal_cell(F.col(n), f.dataType) for n, f in zip(names, plain.schema.fields, strict=True)]
    return plain.select(F.array(*cells).alias("row") if cells else F.array().cast("array<string>").alias("row"), F.monotonically_increasing_id().alias("place"))


def same_rows(pred: DataFrame, gold: DataFrame, ordered: bool) -> bool:
    """Equal as lists if ordered, else as multisets: by digests, so rows are neither shuffled, kept nor collected."""
    key = Key.drawn()
    return digest(pred, key).same(digest(gold, key), ordered)


def differing_rows(pred: DataFrame, gold: DataFrame, ordered: bool) -> DataFrame:
    """What keeps two results of normal rows from being the same: i, pred_row, gold_row of unlike places if ordered, else row,
    pred_times, gold_times of rows that one has more often. Order needs frames that come the same way each time (stored ones).
    """
    if ordered:
        number = lambda df, n: numbered_in_place(df, "place").select("i", F.col("row").alias(n))
        return number(pred, "pred_row").join(number(gold, "gold_row"), "i", "full").where(~F.col("pred_row").eqNullSafe(F.col("gold_row")))
    counts = lambda df, n: df.groupBy("row").agg(F.count("*").alias(n))
    both = counts(pred, "pred_times").join(counts(gold, "gold_times"), "row", "full").na.fill(0, ["pred_times", "gold_times"])
    return both.where("pred_times <> gold_times")


def execution_match(pred: Execution, gold: Execution, gold_sql: str) -> dict:
    """score 0 or 1 and its details; any failure scores 0. Order counts if the gold query orders. Both come of one executor."""
    if not pred.ok or not gold.ok:
        return {"score": 0, "pred_ok": pred.ok, "gold_ok": gold.ok, "pred_error": pred.error, "gold_error": gold.error, "pred_rows_count": pred.count, "gold_rows_count": gold.count}
    ordered = X.has_order_by_text(gold_sql)
    same = pred.digest.same(gold.digest, ordered)
    heads = {f"{n}_rows_head": [list(r) for r in e.digest.head] for n, e in (("pred", pred), ("gold", gold))}
    return {"score": int(same), "pred_ok": True, "gold_ok": True, "ordered": ordered, "pred_rows_count": pred.count, "gold_rows_count": gold.count, **heads}


def exact_match(df: DataFrame, pred: str, gold: str) -> DataFrame:
    """df with em 0 or 1 and both normal forms; an empty prediction scores 0."""
    out = df.withColumns({"normalized_pred": X.normal_sql(F.col(pred)), "normalized_gold": X.normal_sql(F.col(gold))})
    hit = (F.col("normalized_pred") != "") & (F.col("normalized_pred") == F.col("normalized_gold"))
    return out.withColumn("em", hit.cast("int"))


def score_pairs(spark: SparkSession, pairs: list[tuple[str, str]], timeout: float = TIMEOUT, threads: int = 4) -> dict[tuple[str, str], dict]:
    """Execution match of different (pred, gold) pairs; each different statement runs once."""
    executor = Executor(spark, timeout)
    statements = sorted({s for p in pairs for s in p})
    with ThreadPoolExecutor(threads) as pool:
        done = dict(zip(statements, pool.map(executor.execute, statements), strict=True))
    return {p: execution_match(done[p[0]], done[p[1]], p[1]) for p in set(pairs)}


DETAIL = "score int, pred_ok boolean, gold_ok boolean, ordered boolean, pred_error string, gold_error string, pred_rows_count long, gold_rows_count long, pred_rows_head array<array<string>>, gold_rows_head array<array<string>>"


def execution_accuracy(df: DataFrame, pred: str, gold: str, timeout: float = TIMEOUT) -> DataFrame:
    """df with ex 0 or 1 and ex_detail. Statements are a question set, as small as what a model answered."""
    spark = df.sparkSession
    pairs = [(r[0] or "", r[1] or "") for r in df.select(pred, gold).distinct().collect()]
    found = score_pairs(spark, pairs, timeout)
    kind = T._parse_datatype_string(DETAIL)
    rows = [(p, g, tuple(d.get(n) for n in kind.fieldNames())) for (p, g), d in found.items()]
    schema = T.StructType([T.StructField("__p", T.StringType()), T.StructField("__g", T.StringType()), T.StructField("ex_detail", kind)])
    scores = spark.createDataFrame(rows, schema)
    on = (F.coalesce(F.col(pred), F.lit("")) == F.col("__p")) & (F.coalesce(F.col(gold), F.lit("")) == F.col("__g"))
    return df.join(scores, on, "left").drop("__p", "__g").withColumn("ex", F.col("ex_detail.score"))


def running_means(scored: DataFrame, *metrics: str) -> DataFrame:
    """Means of the scores; failed samples have none and leave the denominator."""
    return scored.agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])
