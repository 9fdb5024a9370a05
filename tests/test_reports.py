"""Whole reports and the command line, on small files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracewright.__main__ import main
from tracewright.operators import reports as R
from tracewright.operators.pipeline import RunConfig
from tracewright.sources import generators as G
from tracewright.sources.readers import EVENT_LOG


def runs(spark):
    """Four runs of 1,655 items with the published cells of the first two comparisons and the published accuracy of the last."""
    rows = []
    for i in range(1655):
        z = i < 676
        at = i if z else i - 676
        lex, lf = (at < 576, at < 576) if z else (at < 126, at < 175)
        rows.append((f"{i % 205}_{i // 205}", ["easy", "medium", "hard", "extra"][i % 4], int(z), int(lex), int(lf), int(i < 757)))
    frame = spark.createDataFrame(rows, "run_id string, difficulty string, zeroshot int, lexicon int, lf int, combined int")
    return {c: frame.select("run_id", "difficulty", F.col(c).alias("score")) for c in R.CONDITIONS}


def test_statistics_report(spark, tmp_path):
    found = R.statistics_report(spark, runs(spark), f"{tmp_path}/all.json")
    with open(tmp_path / "all.json") as file:
        stored = json.load(file)
    assert set(stored) == {"RQ1", "RQ2", "RQ3a", "RQ3b"} and set(stored["RQ3a"]) == {"lexicon_vs_combined", "lf_vs_combined"}
    one, two = found["RQ1"], found["RQ2"]
    assert [one["mcnemar"][k] for k in "abcd"] == [576, 100, 126, 853]
    assert one["mcnemar"]["p_value"] == pytest.approx(0.09631738724340333) and one["mcnemar"]["delta"] == pytest.approx(0.01570996978851963)
    assert one["bootstrap_ci"]["ci_lo"] == pytest.approx(-0.0018, abs=0.002) and one["bootstrap_ci"]["ci_hi"] == pytest.approx(0.0338, abs=0.002) and one["bootstrap_ci"]["p_boot"] == pytest.approx(0.0886, abs=0.012)
    assert [two["mcnemar"][k] for k in "abcd"] == [576, 100, 175, 804] and set(one["subgroups"]) == {"easy", "medium", "hard", "extra"}
    # published figures of the interaction
    did = found["RQ3b"]["did"]
    want = {"n_items": 1655, "obs_did": -0.012084592145015116, "acc_zeroshot": 0.40845921450151057, "acc_lexicon": 0.4241691842900302, "acc_lf": 0.45377643504531723, "acc_combined": 0.45740181268882174, "marginal_lex": 0.01570996978851963, "marginal_lf": 0.04531722054380666, "expected_add": 0.06102719033232629, "actual_combined_gain": 0.04894259818731117}
    assert {k: did[k] for k in want} == pytest.approx(want)
    glmm = found["RQ3b"]["glmm"]
    assert (glmm["n_obs"], glmm["n_questions"]) == (6620, 205)
    assert glmm["params"]["lex"] == pytest.approx(0.01570997, abs=1e-6) and glmm["params"]["lf"] == pytest.approx(0.04531722, abs=1e-6)


def files(tmp_path):
    random.seed(2)
    dev, gold, meta = [], [], ["id\tutterance\tspider_class\tdomain_value_class"]
    for g in range(4):
        sql = f"SELECT COUNT(*) FROM event_log WHERE activity = 'act {g}' AND cost > {g + 10}"
        for k in range(3):
            words = " ".join(random.choices("how many events of the act were done with cost more than all others".split(), k=9))
            dev.append({"id": f"{g}_{k}", "group_id": str(g), "question": f"{words} act {g}", "query": sql, "db_id": "event_log", "u_class": "x"})
            gold.append(f"{sql}\tevent_log\t{g}_{k}")
            meta.append(f"{g}_{k}\tu\teasy\tv")
    (tmp_path / "dev.json").write_text(json.dumps(dev))
    (tmp_path / "gold.sql").write_text("\n".join(gold) + "\n")
    (tmp_path / "meta.tsv").write_text("\n".join(meta) + "\n")


def test_corpus_from_the_command_line(spark, tmp_path, capsys):
    files(tmp_path)
    assert main(["corpus", *(x for n, f in (("dev", "dev.json"), ("gold", "gold.sql"), ("meta", "meta.tsv"), ("out", "out")) for x in (f"--{n}", f"{tmp_path}/{f}"))], spark) == 0
    written = json.loads(capsys.readouterr().out)
    assert all(written.values()) and len(written) == 15
    read = lambda name: spark.read.option("header", True).csv(f"{tmp_path}/out/{name}.csv")
    assert {(r["group_id"], r["n_utterances"], r["gold_sql_consistent"]) for r in read("dataset_validation").collect()} == {(str(g), "3", "true") for g in range(4)}
    assert read("jaccard_summary").columns == ["metric", "value"] and {r["metric"]: r["value"] for r in read("jaccard_summary").collect()}["n"] == "8"
    assert read("corpus_analysis_utterance_level").count() == 12 and read("corpus_lexical_summary").first()["mtld_threshold"] == "0.72"
    assert {r["measure"] for r in read("group_lexical_summary").collect()} == {"ttr", "mtld"}


def test_run_and_stats_from_the_command_line(spark, tmp_path, capsys):
    files(tmp_path)
    spark.createDataFrame([(1, "act 1", None, None, 20.0, "c")], EVENT_LOG).write.parquet(f"{tmp_path}/log.parquet")
    (tmp_path / "run.json").write_text(json.dumps({"model": "none", "source": "echo", "results_root": f"{tmp_path}/results", "sql_timeout": 60, "metric": "EM", "limit": 99}))
    options = [x for n, f in (("dev", "dev.json"), ("gold", "gold.sql"), ("log", "log.parquet")) for x in (f"--{n}", f"{tmp_path}/{f}")]
    assert main(["--config", f"{tmp_path}/run.json", "run", "--limit", "5", *options], spark) == 0
    meta = json.loads(capsys.readouterr().out)
    assert meta["samples_total"] == 5 and meta["config"]["limit"] == 5 and meta["em_score"] == 0.0 and meta["ex_score"] is None
    for name, run in runs(spark).items():
        run.where("run_id like '1_%'").select(F.concat_ws("\t", "run_id", F.lit("p"), F.lit("g"), "difficulty", F.col("score").cast("string"))).write.text(f"{tmp_path}/{name}.tsv")
    assert main(["stats", *(x for c in R.CONDITIONS for x in (f"--{c}", f"{tmp_path}/{c}.tsv")), "--out", f"{tmp_path}/s.json"], spark) == 0
    assert json.loads((tmp_path / "s.json").read_text())["RQ3b"]["did"]["n_items"] > 100


def test_generators_by_name():
    cfg = RunConfig(model="org/m", source="hosted", api_url="http://h:1/", api_key_name="TOKEN")
    made = G.generator(cfg)
    assert (made.url, made.model, made.key) == ("http://h:1/v1/chat/completions", "org/m", "TOKEN")
    assert G.generator(RunConfig(model="m", source="local", api_url="http://x/chat")).url == "http://x/chat"
    assert G.generator(RunConfig(model="m", source="echo"))([{"role": "user", "content": "?"}]).startswith("```sql")
    for bad in (RunConfig(model="m", source="local"), RunConfig(model="m", source="other")):
        with pytest.raises(ValueError):
            G.generator(bad)


def test_local_model_with_a_stand_in():
    class Tensor(list):
        shape = property(lambda self: (1, len(self[0])))

    class Given(dict):
        def to(self, device):
            return self

    class Tokenizer:
        eos_token_id, chat_template = 0, None

        def __call__(self, text, return_tensors):
            self.text = text
            return Given(input_ids=Tensor([[1, 2, 3]]))

        def decode(self, ids, skip_special_tokens):
            return f"SELECT {len(ids)}"

    class Model:
        device = "cpu"

        def generate(self, input_ids, **options):
            self.options = options
            return [input_ids[0] + [7, 8]]

    made = G.LocalModel("m")
    made._held = Tokenizer(), Model()
    answer = made([{"role": "user", "content": "hello"}])
    assert answer.text == "SELECT 2" and made._held[0].text == "[user] hello\n[assistant]" and made._held[1].options["do_sample"] is False
    assert (answer.usage["prompt_tokens"], answer.usage["completion_tokens"], answer.usage["total_tokens"]) == (3, 2, 5)
    assert "_held" not in made.__getstate__()
