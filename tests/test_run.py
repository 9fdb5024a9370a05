"""Sources, sinks, streams and a whole run with a generator without a model."""

import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tracewright.operators import corpus as C
from tracewright.operators import pipeline as P
from tracewright.sources import readers as R
from tracewright.sources.endpoint import ChatEndpoint
from tracewright.sources import sinks as S
from tracewright.streaming import results as T


@pytest.fixture(scope="module")
def log(spark):
    rows = [(i, ["a", "b"][i % 2], datetime(2024, 1, 1, i), "r", 1.0 * i, f"c{i % 3}") for i in range(9)]
    df = spark.createDataFrame(rows, R.EVENT_LOG)
    R.register(df)
    return df


def test_gold_file(spark, tmp_path):
    (tmp_path / "gold.txt").write_bytes(b"SELECT 1\tevent_log\t0_0\r\n\r\nbroken line\nSELECT 2\tevent_log\t0_1\textra\n")
    good, bad = R.gold_file(spark, str(tmp_path / "gold.txt"))
    assert sorted((r["id"], r["gold_sql"], r["line"]) for r in good.collect()) == [("0_0", "SELECT 1", 0), ("0_1", "SELECT 2", 3)]
    assert [r["value"] for r in bad.collect()] == ["broken line"]


def test_gold_by_id_else_by_line_else_of_dev(spark, tmp_path):
    (tmp_path / "dev.json").write_text(json.dumps([{"id": f"0_{i}", "question": "q", "query": "OWN"} for i in range(4)]))
    (tmp_path / "gold.txt").write_text("LINE 0\te\t0_2\nLINE 1\te\tother\nLINE 2\te\tanother\nbroken\n")
    samples = P.load(R.dev_json(spark, str(tmp_path / "dev.json")), R.gold_file(spark, str(tmp_path / "gold.txt"))[0])
    assert {r["id"]: r["gold_sql"] for r in samples.collect()} == {"0_0": "LINE 0", "0_1": "LINE 1", "0_2": "LINE 0", "0_3": "OWN"}


def test_json_and_tsv(spark, tmp_path):
    (tmp_path / "dev.json").write_text(json.dumps([{"id": "0_0", "question": "q", "question_toks": ["q"]}, {"id": "0_1", "question": "p"}]))
    assert R.dev_json(spark, str(tmp_path / "dev.json")).count() == 2
    # a score that is no number, or none at all, is 0; a line of too many fields is skipped
    lines = ['0_0\tSELECT "a\tSELECT b\teasy\t1', "0_1\tp\tg\teasy\tx", "0_2\tp\tg\teasy\t", "0_3\tp\tg\teasy\t1.0", "", "0_4\tp", "0_5\tp\tg\teasy\t1\tmore"]
    (tmp_path / "scores_m_EX.tsv").write_text("\r\n".join(lines))
    rows = R.score_tsv(spark, str(tmp_path / "scores_m_EX.tsv")).collect()
    assert sorted((r["run_id"], r["predicted"], r["score"], r["question_id"]) for r in rows) == [("0_0", 'SELECT "a', 1, "0"), ("0_1", "p", 0, "0"), ("0_2", "p", 0, "0"), ("0_3", "p", 1, "0"), ("0_4", "p", 0, "0")]
    assert {r["model_key"] for r in R.score_files(spark, str(tmp_path), "EX").collect()} == {"m"}
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n\t\n")
    assert R.header_tsv(spark, str(tmp_path / "t.tsv"), quoted=False).count() == 1
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "x", "prompt": "p"}]}))
    assert [tuple(r) for r in R.prebuilt_prompts(spark, str(tmp_path / "q.json")).collect()] == [("x", "p")]
    assert len(R.fingerprint(spark, str(tmp_path / "q.json")).first()["sha256"]) == 64


def test_nocase_log(spark, log, tmp_path):
    log.write.parquet(str(tmp_path / "log"))
    assert R.event_log(spark, str(tmp_path / "log"), nocase=True).where("activity = 'A'").count() == 5
    assert R.event_log(spark, str(tmp_path / "log")).where("activity = 'A'").count() == 0


def test_csv_sink_skips_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert not S.csv(df.limit(0), str(tmp_path / "none"), ["a"]) and not (tmp_path / "none").exists()
    assert S.csv(df, str(tmp_path / "one"), ["b", "a"])
    assert spark.read.option("header", True).csv(str(tmp_path / "one")).columns == ["b", "a"]


def test_plain_json():
    assert S.plain({"a": float("nan"), 1: [float("nan"), 2]}) == {"a": None, "1": [None, 2]}


def test_run_and_resume(spark, log, tmp_path):
    dev = spark.createDataFrame([("0_0", "how many?", "SELECT COUNT(*) FROM event_log"), ("0_1", "which?", "SELECT activity FROM event_log")], "id string, question string, query string")
    dev = dev.withColumn("group_id", F.lit(None).cast("string"))
    gold = spark.createDataFrame([("0_0", "SELECT COUNT(*) FROM event_log;")], "id string, gold_sql string")
    samples = P.load(dev, gold)
    assert {r["group_id"] for r in samples.collect()} == {"0"}
    cfg = P.RunConfig(model="org/Tiny-1", results_root=str(tmp_path), api_key="secret", sql_timeout=60, resume=True, limit=1)
    meta = P.run(spark, samples, P.echo, cfg)
    assert meta["experiment_name"] == "oss_tiny_1_zeroshot" and meta["ex_score"] == 1.0 and meta["em_score"] == 1.0 and meta["samples_total"] == 1
    assert meta["config"]["api_key"] == "***REDACTED***"
    cfg.limit = None
    meta = P.run(spark, samples, P.echo, cfg)
    assert meta["samples_total"] == 2 and meta["ex_score"] == 0.5
    path = f"{tmp_path}/english/oss_tiny_1_zeroshot/predictions.jsonl"
    folder = f"{tmp_path}/english/oss_tiny_1_zeroshot"
    assert sorted(r["ex"] for r in P.rescore(spark, path, cfg, f"{folder}/evaluations").collect()) == [0, 1]
    for where in (folder, f"{folder}/evaluations"):
        assert {(r["run_id"], r["score"]) for r in R.score_tsv(spark, f"{where}/scores_opr_tiny_1_EX.tsv").collect()} == {("0_0", 1), ("0_1", 0)}
    assert spark.read.text(f"{folder}/RESULTS_MODEL-org-Tiny-1.txt").count() == 2
    assert meta["git_sha"] is None or len(meta["git_sha"]) == 40


def test_abort_writes_what_was_answered(spark, log, tmp_path):
    def half(messages):
        if "bad" in messages[-1]["content"]:
            raise ValueError("no answer")
        return P.Answer("SELECT COUNT(*) FROM event_log", {"total_tokens": 7, "prompt_ms": 1.5})

    (tmp_path / "dev.json").write_text(json.dumps([{"id": f"0_{i}", "question": "bad" if i == 1 else "good", "query": "SELECT COUNT(*) FROM event_log"} for i in range(3)]))
    samples = P.load(R.dev_json(spark, str(tmp_path / "dev.json")), spark.createDataFrame([], "id string, gold_sql string")).coalesce(1)
    cfg = P.RunConfig(model="m", results_root=str(tmp_path / "out"), on_error="abort", sql_timeout=60)
    with pytest.raises(RuntimeError, match="Aborting on error at 0_1: ValueError: no answer"):
        P.run(spark, samples, half, cfg, dataset=str(tmp_path / "dev.json"))
    meta = json.loads((tmp_path / "out/english/oss_m_zeroshot/run_meta.json").read_text())
    assert meta["samples_failed"] == 1 and meta["finished_at"] and len(meta["dataset_sha256"]) == 64
    cfg.on_error = "skip"
    meta = P.run(spark, samples, half, P.RunConfig(model="n", results_root=str(tmp_path / "out"), sql_timeout=60))
    assert meta["samples_total"] == 3 and meta["samples_failed"] == 1 and meta["ex_score"] == 1.0 and meta["tokens_per_query"] == 7
    assert not [p for p in (tmp_path / "out/english/oss_n_zeroshot").iterdir() if p.name.startswith(".answers")]


def test_a_chat_endpoint(monkeypatch):
    """Answers, counts, authentication and errors of a server on this machine."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers["Authorization"], body))
            status = int(body["messages"][-1]["content"])
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "SELECT 1"}}], "usage": {"total_tokens": 5}, "timings": {"prompt_ms": 2.0, "other": 1}}).encode() if status == 200 else b"sorry")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("CHAT_KEY", "user:secret")
    ask = ChatEndpoint(f"http://127.0.0.1:{server.server_port}/v1/chat/completions", "m", key="CHAT_KEY", options={"seed": 3, "top_p": None}, timeout=10)
    say = lambda x: ask([{"role": "user", "content": x}])
    answer = say("200")
    assert answer.text == "SELECT 1" and answer.usage == {"total_tokens": 5, "prompt_ms": 2.0}
    assert seen[0][0].startswith("Basic ") and seen[0][1]["seed"] == 3 and "top_p" not in seen[0][1] and seen[0][1]["stop"]
    for status, kind in (("401", P.AuthError), ("429", P.RateLimitError), ("503", P.TransientError), ("404", ValueError)):
        with pytest.raises(kind):
            say(status)
    server.shutdown()
    server.server_close()
    with pytest.raises(P.TransientError):
        say("200")
    assert "secret" not in repr(ask)


def test_failed_samples_leave_the_denominator(spark, log):
    def fails(messages):
        raise ValueError("no answer")

    samples = spark.createDataFrame([("a", "q", "SELECT 1")], "id string, question string, gold_sql string").withColumn("prompt_messages", P.prompt(F.col("question"), "lf"))
    row = P.score(P.generate(samples, fails), P.RunConfig(model="m")).first()
    assert row["error"] == "ValueError: no answer" and row["em"] is None and row["ex"] is None


def test_errors_by_status():
    assert isinstance(P.error_for(401), P.AuthError) and isinstance(P.error_for(429), P.RateLimitError)
    assert isinstance(P.error_for(503), P.TransientError) and isinstance(P.error_for(404), ValueError)


def test_corpus_stages(spark):
    rows = [("0_0", "0", 0, "How many different cases in 2018?", "SELECT COUNT(DISTINCT idcase) FROM event_log WHERE timestamp LIKE '2018%'"), ("0_1", "0", 1, "How many cases?", "select  count(distinct idcase) from event_log where timestamp LIKE '2018%'"), ("1_1", "1", 1, "no anchor", "SELECT 1")]
    corpus = spark.createDataFrame(rows, "utterance_id string, group_id string, position int, question string, gold_sql string")
    v = {r["group_id"]: r for r in C.validation(corpus).collect()}
    assert v["0"]["gold_sql_consistent"] and v["0"]["n_utterances"] == 2
    assert [r["group_id"] for r in C.jaccard_means(corpus).collect()] == ["0"]
    level = {r["utterance_id"]: r for r in C.utterance_level(corpus).collect()}
    assert level["0_0"]["ops_present"] == "COUNT;DISTINCT;Temporal" and level["0_0"]["val_n_lexicalized"] == 1
    assert level["0_1"]["val_n_lexicalized"] == 0 and level["1_1"]["val_n_literals"] == 0
    s = C.value_summary(C.value_rows(corpus)).first()
    assert s["applicable_utterances"] == 2 and s["pct_lexicalized"] == 50.0
    assert C.describe(corpus.limit(0), "position").first()["mean"] is None
    q = C.quartiles(spark.range(8), "id").first()
    assert (q["q1"], q["q3"]) == (2, 6)
    many = spark.range(1000, numPartitions=7).selectExpr("id * 37 % 1000 AS v")
    q = C.quartiles(many, "v").first()
    assert (q["q1"], q["q3"]) == (250, 750)
    dev = spark.createDataFrame([("0_0", "q", "OWN", None, None), ("0_1", "q", "OWN", None, None)], "id string, question string, query string, group_id string, u_class string").withColumn("line", F.col("id").substr(3, 1).cast("long"))
    gold = spark.createDataFrame([("0_0", "BY ID", 5), ("other", "BY LINE", 1)], "id string, gold_sql string, line int")
    meta = spark.createDataFrame([("0_0", "easy", "d", "text"), ("0_1", "hard", "d", " ")], "id string, spider_class string, domain_value_class string, utterance string")
    built = {r["utterance_id"]: (r["gold_sql"], r["spider_class"]) for r in C.build(dev, gold, meta).collect()}
    assert built == {"0_0": ("BY ID", "easy"), "0_1": ("BY LINE", "no_hardness")}


def test_streams(spark, log, tmp_path):
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(R.EVENT_LOG).parquet(str(tmp_path / "in"))
    T.append(T.resumed(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 9
    T.append(T.resumed(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 9  # nothing new
    q = T.running_totals(stream, "cost").writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("totals").first()["n"] == 9
    q = T.events_after(stream, "a", "5 HOURS", "1 day").writeStream.format("memory").queryName("later").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sum(1 for i in range(9) for j in range(9) if j % 2 == 0 and i % 3 == j % 3 and j < i <= j + 5)
    assert spark.table("later").count() == want
    q = T.windowed_counts(stream, "2 hours", "1 hour").writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r["n"] for r in spark.table("wins").collect()) == 9
