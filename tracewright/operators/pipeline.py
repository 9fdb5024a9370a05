"""The run of a benchmark: load samples, build prompts, generate, clean, execute, score, write.

No model is reached from here: a generator is any callable of messages, and `echo` is a deterministic one.
"""

from __future__ import annotations

import json
import subprocess
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import ClassVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sqltext as X
from ..functions import text as T
from ..sources import readers, sinks
from . import evaluate as E

Messages = list[dict[str, str]]


@dataclass
class RunConfig:
    """What a run does. Secrets come from the environment and are never written out."""

    model: str
    source: str = "local"
    prompt: str = "zeroshot"
    metric: str = "both"
    language: str = "english"
    temperature: float = 0.0
    max_tokens: int = 2000
    limit: int | None = None
    resume: bool = False
    on_error: str = "skip"
    sql_timeout: float = E.TIMEOUT
    results_root: str = "results"
    run_tag: str | None = None
    api_key: str | None = None
    #: The environment variable that holds the secret on the executors.
    api_key_name: str | None = None
    api_url: str | None = None
    request_timeout: float = 120.0

    def public(self) -> dict:
        return {k: "***REDACTED***" if k in ("api_key",) and v is not None else v for k, v in asdict(self).items()}


@dataclass
class Answer:
    """What a generator may give in place of a text: the text, and counts and times by name."""

    text: str
    usage: dict = field(default_factory=dict)

    #: Counts are whole numbers, all others are floats.
    USAGE: ClassVar[dict[str, type]] = {
        "prompt_tokens": int, "completion_tokens": int, "total_tokens": int, "prompt_n": int, "prompt_ms": float, "prompt_per_token_ms": float,
        "prompt_per_second": float, "predicted_n": int, "predicted_ms": float, "predicted_per_token_ms": float, "predicted_per_second": float,
    }


class AuthError(Exception):
    """The endpoint refuses the credentials: the run ends."""


class RateLimitError(Exception):
    """Asked too often: worth another try."""


class TransientError(Exception):
    """Timeouts and failures of the server: worth another try."""


def error_for(status: int, text: str = "") -> Exception:
    """The error of an HTTP status, which decides between retry, skip and abort."""
    if status in (401, 403):
        return AuthError(f"{status} {text}".strip())
    if status == 429:
        return RateLimitError(f"{status} {text}".strip())
    if status >= 500 or status == 408:
        return TransientError(f"{status} {text}".strip())
    return ValueError(f"{status} {text}".strip())


HEADER = "You translate questions about one table into a single SQL query. Answer with SQL only.\nTable: event_log(id, activity, timestamp, resource, cost, idcase)"
LEXICON = "Words and columns:\n" + "\n".join(f"- {c}: {', '.join(w)}" for c, w in X.COLUMN_SYNONYMS.items())
ENTITIES = "First decide what is asked for: events (rows), cases (different idcase), activities or resources (their column)."
FORMS = (
    "Write a logical form first and compile it: a condition on single events becomes WHERE, an aggregate condition HAVING; "
    "a superlative keeps ties by comparing the aggregate with its extreme or with the N best values; before and after are self joins on idcase; "
    "never is NOT IN, both is INTERSECT, but not is EXCEPT; the first or last event is that of least or greatest timestamp."
)
FOOTER = "Use only the columns of the table. End with a semicolon."
#: Prompt strategies: the blocks between header and footer.
STRATEGIES: dict[str, tuple[str, ...]] = {"zeroshot": (), "lexicon": (LEXICON,), "lf": (ENTITIES, FORMS), "lf-lite": (ENTITIES,), "lexicon-lf": (LEXICON, ENTITIES, FORMS)}


def prompt(question: Column, strategy: str) -> Column:
    """array<struct<role, content>> of a strategy."""
    system = "\n".join((HEADER, *STRATEGIES[strategy], FOOTER))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", F.concat(F.lit("Question: "), question)))


def load(dev: DataFrame, gold: DataFrame, hardness: DataFrame | None = None, prebuilt: DataFrame | None = None) -> DataFrame:
    """Samples: dev with gold SQL by id, else by line where both have it, else that of dev; hardness and prebuilt prompt by id with defaults."""
    out = dev.join(gold.select("id", "gold_sql"), "id", "left")
    if "line" in dev.columns and "line" in gold.columns:
        by_line = gold.select(F.col("line").cast("long").alias("line"), F.col("gold_sql").alias("__by_line"))
        out = out.join(by_line, "line", "left").withColumn("gold_sql", F.coalesce("gold_sql", "__by_line"))
    if hardness is not None:
        out = out.join(hardness.select("id", "hardness"), "id", "left")
    if prebuilt is not None:
        out = out.join(prebuilt.select("id", F.col("prompt").alias("prebuilt_prompt")), "id", "left")
    text = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c) if c in out.columns else F.lit(d).alias(c)
    group = F.coalesce("group_id", F.substring_index("id", "_", 1)).alias("group_id")
    return out.select("id", group, "question", text("db_id", "event_log"), F.coalesce("gold_sql", "query", F.lit("")).alias("gold_sql"), text("hardness", "no_hardness"), text("prebuilt_prompt", ""), *[c for c in ("line",) if c in out.columns])


def echo(messages: Messages) -> str:
    """A generator without a model: counts all events."""
    return "```sql\nSELECT COUNT(*) FROM event_log;\n```"


def generate(samples: DataFrame, generator: Callable[[Messages], str | Answer], retries: int = 3, pause: float = 1.5, abort: bool = False) -> DataFrame:
    """samples with raw_response, latency_ms, error, and the counts and times of Answer. Calls run on the executors, a batch of
    rows at a time.

    Rate limits and transient failures are tried again, a refused credential ends the job, anything else
    becomes the row's error. With abort a task asks no more after its first error; the rows it leaves out aren't in the result.
    """

    def ask(messages: Messages) -> tuple[str | Answer, float, str | None]:
        start = time.monotonic()
        for turn in range(retries + 1):
            try:
                return generator(messages), (time.monotonic() - start) * 1000, None
            except AuthError:
                raise
            except (RateLimitError, TransientError) as e:
                last = e
                time.sleep(pause * 2**turn if turn < retries else 0)
            except Exception as e:
                return "", (time.monotonic() - start) * 1000, f"{type(e).__name__}: {e}"
        return "", (time.monotonic() - start) * 1000, f"{type(last).__name__}: {last}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = False
        for part in parts:
            rows = []
            for ident, messages in zip(part["id"], part["m"], strict=True):
                if failed and abort:
                    break
                answer, took, error = ask([dict(m.asDict() if hasattr(m, "asDict") else m) for m in messages])
                failed = failed or error is not None
                answer = answer if isinstance(answer, Answer) else Answer(answer)
                usage = [None if answer.usage.get(k) is None else kind(answer.usage[k]) for k, kind in Answer.USAGE.items()]
                rows.append((ident, answer.text, took, error, *usage))
            yield pd.DataFrame(rows, columns=names).astype(object)

    names = ["id", "raw_response", "latency_ms", "error", *Answer.USAGE]
    kinds = ", ".join(f"{k} {'long' if kind is int else 'double'}" for k, kind in Answer.USAGE.items())
    asked = samples.select("id", F.col("prompt_messages").alias("m")).mapInPandas(run, f"id string, raw_response string, latency_ms double, error string, {kinds}")
    return asked.join(samples, "id")


def score(generated: DataFrame, cfg: RunConfig) -> DataFrame:
    """predicted_sql, em, ex and execution outcome of generated samples; failed samples have no score."""
    out = generated.withColumn("predicted_sql", F.when(F.col("error").isNull(), X.clean_sql(F.col("raw_response"))))
    good = F.col("error").isNull()
    if cfg.metric in ("EM", "both"):
        out = E.exact_match(out, "predicted_sql", "gold_sql").withColumn("em", F.when(good, F.col("em")))
        out = out.withColumn("em_detail", F.struct("normalized_pred", "normalized_gold")).drop("normalized_pred", "normalized_gold")
    if cfg.metric in ("EX", "both"):
        out = E.execution_accuracy(out, "predicted_sql", "gold_sql", cfg.sql_timeout).withColumn("ex", F.when(good, F.col("ex")))
        out = out.withColumn("pred_exec_ok", F.col("ex_detail.pred_ok")).withColumn("pred_exec_error", F.col("ex_detail.pred_error"))
    return out


def experiment(spark: SparkSession, cfg: RunConfig) -> str:
    """The folder of a run: the same configuration gives the same name."""
    name = T.experiment_name(F.lit(cfg.source), F.lit(cfg.model), F.lit(cfg.prompt), F.lit(cfg.run_tag))
    return f"{cfg.results_root}/{cfg.language}/{spark.range(1).select(name).first()[0]}"


def _commit() -> str | None:
    """The commit of the working folder, if it is a checkout."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def _score_files(spark: SparkSession, scored: DataFrame, folder: str, model: str, mode: str = "append") -> None:
    for metric in ("em", "ex"):
        if metric in scored.columns:
            name = spark.range(1).select(T.scores_filename(F.lit(model), F.lit(metric.upper()))).first()[0]
            sinks.scores(scored, f"{folder}/{name}", metric, mode)


def run(spark: SparkSession, samples: DataFrame, generator: Callable[[Messages], str | Answer], cfg: RunConfig, dataset: str | None = None) -> dict:
    """The whole run over samples: writes predictions, scores, statements and metadata; gives the metadata.

    Answers are written before they are scored, so that none is asked for again when an executor is lost later. With
    resume, ids of the predictions file are skipped, and totals cover all of the file. With on_error `abort` the run
    ends at an error: what was answered is written, and RuntimeError names the sample. dataset: the file that
    the samples are from, whose SHA-256 the metadata holds.
    """
    folder = experiment(spark, cfg)
    path, raw = f"{folder}/predictions.jsonl", f"{folder}/.answers-{uuid.uuid4().hex}"
    sha = readers.fingerprint(spark, dataset).first()["sha256"] if dataset else None
    meta = {"experiment_name": folder.rpartition("/")[2], "config": cfg.public(), "started_at": datetime.now(UTC).isoformat(), "finished_at": None, "git_sha": _commit(), "dataset_sha256": sha}
    sinks.metadata(spark, meta, f"{folder}/run_meta.json")
    if cfg.limit is not None:
        samples = samples.orderBy("id").limit(cfg.limit)
    every = samples
    if cfg.resume and sinks.exists(spark, path):
        samples = samples.join(readers.completed_ids(spark, path), "id", "left_anti")
    built = samples.withColumn("prompt_messages", F.when(F.col("prebuilt_prompt") != "", F.array(F.struct(F.lit("user").alias("role"), F.col("prebuilt_prompt").alias("content")))).otherwise(prompt(F.col("question"), cfg.prompt)))
    generate(built, generator, abort=cfg.on_error == "abort").write.parquet(raw)
    done = score(spark.read.parquet(raw), cfg).cache()
    sinks.append_jsonl(done.drop("group_id", "prebuilt_prompt", "line"), path)
    _score_files(spark, done, folder, cfg.model)
    stopped = done.where("error is not null").orderBy("id").first() if cfg.on_error == "abort" else None
    done.unpersist()
    sinks.discard(spark, raw)
    stored = readers.predictions(spark, path)
    name = spark.range(1).select(T.results_filename(F.lit(cfg.model))).first()[0]
    order = "line" if "line" in every.columns else "id"
    sinks.statements(every.select("id", *{order} - {"id"}).join(stored.select("id", "predicted_sql").dropDuplicates(["id"]), "id"), f"{folder}/{name}", order)
    meta |= {"finished_at": datetime.now(UTC).isoformat(), **sinks.totals(stored)}
    sinks.metadata(spark, meta, f"{folder}/run_meta.json")
    if stopped:
        raise RuntimeError(f"Aborting on error at {stopped['id']}: {stopped['error']}")
    return json.loads(json.dumps(sinks.plain(meta)))


def rescore(spark: SparkSession, path: str, cfg: RunConfig, folder: str | None = None) -> DataFrame:
    """Stored predictions scored anew; with a folder, its score files are written there, in place of earlier ones."""
    stored = readers.predictions(spark, path).select("id", "question", "hardness", "predicted_sql", "gold_sql", "error")
    out = E.exact_match(stored, "predicted_sql", "gold_sql").drop("normalized_pred", "normalized_gold")
    out = E.execution_accuracy(out, "predicted_sql", "gold_sql", cfg.sql_timeout) if cfg.metric != "EM" else out
    if folder:
        _score_files(spark, out, folder, cfg.model, "overwrite")
    return out
