"""Sources: the formats that a benchmark run reads, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered, numbered_in_place

EVENT_LOG = "id bigint, activity string, timestamp timestamp_ntz, resource string, cost double, idcase string"
DEV = "id string, group_id string, question string, question_toks array<string>, query string, db_id string, u_class string"
SCORES = "run_id string, predicted string, gold string, difficulty string, score int"
PREDICTIONS = (
    "id string, question string, db_id string, hardness string, prompt_messages array<struct<role string, content string>>, raw_response string, "
    "predicted_sql string, gold_sql string, em int, ex int, em_detail struct<normalized_pred string, normalized_gold string>, "
    "ex_detail struct<pred_ok boolean, gold_ok boolean, ordered boolean, pred_error string, gold_error string, pred_rows_count bigint, gold_rows_count bigint, "
    "pred_rows_head array<array<string>>, gold_rows_head array<array<string>>>, latency_ms double, prompt_tokens bigint, completion_tokens bigint, "
    "total_tokens bigint, prompt_n bigint, prompt_ms double, prompt_per_token_ms double, prompt_per_second double, predicted_n bigint, predicted_ms double, "
    "predicted_per_token_ms double, predicted_per_second double, pred_exec_ok boolean, pred_exec_error string, error string"
)


def event_log(spark: SparkSession, path: str, nocase: bool = False) -> DataFrame:
    """A Parquet event log. With nocase its texts compare without case, at the price of filter pushdown."""
    log = spark.read.schema(EVENT_LOG).parquet(path)
    return log.withColumns({c: F.collate(F.col(c), "UTF8_LCASE") for c in ("activity", "resource", "idcase")}) if nocase else log


def register(log: DataFrame, name: str = "event_log") -> None:
    """The one view that queries run against; a view can't be written to."""
    log.createOrReplaceTempView(name)


def dev_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of questions, one file."""
    # a multi-line file is read by one task, in order
    return spark.read.schema(DEV).json(path, multiLine=True).withColumn("line", F.monotonically_increasing_id())


def gold_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines `<sql> TAB <db_id> TAB <id>`: (id, db_id, gold_sql, line), and the lines of fewer fields as rejects.

    line counts from 0 over all lines, blank ones included; blank ones are neither gold nor rejects.
    """
    # the parts of one file are read in order; only their counts meet
    read = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r", "").alias("value"), F.monotonically_increasing_id().alias("__at"))
    lines = numbered_in_place(read, "__at").select(F.col("i").cast("int").alias("line"), "value").where(F.trim("value") != "")
    parts = lines.withColumn("p", F.split("value", "\t"))
    good = parts.where(F.size("p") >= 3).select(F.col("p")[2].alias("id"), F.col("p")[1].alias("db_id"), F.col("p")[0].alias("gold_sql"), "line")
    return good, parts.where(F.size("p") < 3).select("line", "value")


def header_tsv(spark: SparkSession, path: str, quoted: bool = True) -> DataFrame:
    """A TSV with header; without quoting, all-null rows are dropped too."""
    read = spark.read.option("sep", "\t").option("header", True).option("escape", '"')
    return read.option("multiLine", True).csv(path) if quoted else read.option("quote", "").csv(path).na.drop(how="all")


def _scores(spark: SparkSession, path: str, *more: Column) -> DataFrame:
    """Rows of a headerless score table, quoting off: lines of more than five fields and blank ones are skipped, missing
    fields are null, and a score is cut to a whole number, 0 if it isn't a number."""
    lines = spark.read.text(path).select("value", *more).where(F.trim("value") != "").withColumn("p", F.split("value", "\t"))
    names = [x.split()[0] for x in SCORES.split(", ")]
    fields = [F.nullif(F.get("p", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names[:-1])]
    number = F.expr("try_cast(trim(get(p, 4)) as double)")
    score = F.when(number.isNull() | F.isnan(number), 0).otherwise(number).cast("int").alias(names[-1])
    return lines.where(F.size("p") <= len(names)).select(*fields, score, *[c for c in lines.columns if c not in ("value", "p")])


def score_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A score table; question_id is what precedes the last underscore."""
    return _scores(spark, path).withColumn("question_id", F.regexp_replace("run_id", r"_[^_]*$", ""))


def score_files(spark: SparkSession, folder: str, metric: str) -> DataFrame:
    """All score tables of a metric in a folder, with the model key found in each file's name."""
    return _scores(spark, f"{folder}/scores_*_{metric}.tsv", F.regexp_extract(F.input_file_name(), rf"scores_(.+)_{metric}\.tsv", 1).alias("model_key"))


def side_by_side(results: dict[str, DataFrame], base: DataFrame, key: str = "id") -> DataFrame:
    """base with the columns of each model's results, suffixed by its key, joined by id."""
    for model, df in results.items():
        base = base.join(df.select(F.col(key), *[F.col(c).alias(f"{c}_{model}") for c in df.columns if c != key]), key, "left")
    return base


def glued(left: DataFrame, right: DataFrame, order_left: str, order_right: str) -> DataFrame:
    """Two frames side by side by row position in the given orders, for files without an id."""
    number = lambda df, by: numbered(df, by).withColumnRenamed("i", "__i")
    return number(left, order_left).join(number(right, order_right), "__i").drop("__i")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of sample records; lines that can't be read are skipped."""
    return spark.read.schema(PREDICTIONS).option("mode", "DROPMALFORMED").json(path)


def completed_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string").option("mode", "DROPMALFORMED").json(path).where("id is not null").distinct()


def prebuilt_prompts(spark: SparkSession, path: str) -> DataFrame:
    """id, prompt out of {questions: [{id, prompt}]}."""
    rows = spark.read.schema("questions array<struct<id: string, prompt: string>>").json(path, multiLine=True)
    return rows.select(F.explode("questions").alias("q")).select("q.id", "q.prompt")


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
