"""Text functions: tokens, MTLD, cleaning, normal form, literals, cues, names."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions import sqltext as X
from tracewright.functions import text as T
from tracewright.operators import corpus


@pytest.fixture(scope="module")
def ask(spark):
    def run(expr, **cols):
        df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
        return df.select(expr).first()[0]

    return run


def test_tokens(ask):
    assert ask(T.tokens("x"), x="Hello, World! it's  OK") == ["hello", "world", "its", "ok"]
    assert ask(T.tokens("x"), x=None) == []
    assert ask(T.ttr(T.tokens("x")), x="a b a b") == 0.5
    assert ask(T.ttr(T.tokens("x")), x="...") == 0.0
    assert ask(T.jaccard(T.token_set("x"), T.token_set("y")), x="a b", y="b c") == pytest.approx(1 / 3, abs=1e-6)
    assert ask(T.jaccard(T.token_set("x"), T.token_set("y")), x="", y="") == 0.0


def test_mtld():
    assert T.mtld_of([]) == 0.0 and T.mtld_of(["a"]) == 0.0
    assert T.mtld_of(["a", "b", "c"]) == 0.0  # all different: no factor
    assert T.mtld_of(["a"] * 4) == pytest.approx(2.0)  # two factors of two tokens
    toks = list("abcabdabeab")
    assert T.mtld_of(toks) == pytest.approx(T.mtld_of(toks[::-1]))


@pytest.mark.parametrize(
    ("raw", "kw", "want"),
    [
        (None, {}, ""),
        ("   ", {}, ""),
        ("SELECT 1", {}, "SELECT 1;"),
        ("```sql\nSELECT  a,\n b FROM t;\n```", {}, "SELECT a, b FROM t;"),
        ("```\nSELECT 1\n```\n```sql\nSELECT 2\n```", {}, "SELECT 1;"),
        ("Sure! Here it is: select a from t", {}, "select a from t;"),
        ("SELECT 1;<|im_end|>\n<|im_start|>user", {}, "SELECT 1;"),
        ("<|im_start|>SELECT 1", {}, "SELECT 1;"),
        ("First count. Final SQL: SELECT 2;", {"cot": True}, "SELECT 2;"),
        ("think\nfinal sql:\n```sql\nSELECT 3\n```", {"cot": True}, "SELECT 3;"),
        ("COUNT(*) FROM t", {"prefix": "SELECT "}, "SELECT COUNT(*) FROM t;"),
        ("SELECT 1; SELECT 2;", {}, "SELECT 1;"),
        ("SELECT 'a  b'  FROM   t", {}, "SELECT 'a  b' FROM t;"),
        ("SELECT 'a;b' FROM t", {}, "SELECT 'a;"),  # split at any semicolon
        (";", {}, ""),
    ],
)
def test_clean_sql(ask, raw, kw, want):
    assert ask(X.clean_sql(F.col("x"), **kw), x=raw) == want


def test_clean_sql_is_idempotent(ask):
    once = ask(X.clean_sql(F.col("x")), x="Well: ```sql\nSELECT  a  FROM t```")
    assert ask(X.clean_sql(F.col("x")), x=once) == once


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("SELECT a , b FROM t;", "select a,b from t", True),
        ("SELECT COUNT(id) FROM t", "SELECT count( * ) FROM t", False),
        ("SELECT COUNT(id) FROM t", "SELECT count(*) FROM t", True),
        ("SELECT COUNT(DISTINCT id) FROM t", "SELECT COUNT(*) FROM t", False),
        ("SELECT a AS x FROM t", "SELECT a FROM t", True),
        ("SELECT a FROM t WHERE b = 'X'", "SELECT a FROM t WHERE b = 'x'", True),
        ("SELECT a FROM t WHERE b = 'x  y'", "SELECT a FROM t WHERE b = 'x y'", False),
    ],
)
def test_normal_sql(ask, a, b, same):
    assert (ask(X.normal_sql(F.col("x")), x=a) == ask(X.normal_sql(F.col("x")), x=b)) == same


def test_literals(ask):
    found = ask(X.literals(F.col("x")), x="SELECT * FROM t WHERE a = 'Bob' AND d > '2018-01-02' AND t LIKE '2016%' AND m = '2018-03' AND x = \"2019-01-01 y\" LIMIT 1")
    assert [tuple(r) for r in found] == [("Bob", "string"), ("2018-01-02", "date_string"), ("2016", "year_pattern"), ("2018-03", "date_string"), ("2019-01-01 y", "date_string"), ("1", "numeric")]


def test_columns_and_operations(ask):
    sql = "SELECT COUNT(DISTINCT idcase) FROM event_log WHERE activity = 'cost' AND cost BETWEEN 1 AND 2"
    assert ask(X.referenced_columns(F.col("x")), x=sql) == ["idcase", "activity", "cost"]
    ops = ask(X.operations(F.col("x")), x=sql)
    assert {k for k, v in ops.items() if v} == {"COUNT", "DISTINCT", "Temporal"}
    assert not ask(X.operations(F.col("x")), x="SELECT strftime('%Y', timestamp) FROM t WHERE timestamp > 3")["Temporal"]


@pytest.mark.parametrize(
    ("kind", "value", "question", "want"),
    [
        ("string", "Pre-Approver", "who is the pre approver?", True),
        ("string", "Bob", "ask BOB", True),
        ("string", "Bob", "ask Rob", False),
        ("numeric", "1", "top 1", False),
        ("numeric", "10", "more than 100", False),
        ("numeric", "10", "more than 10 cases", True),
        ("numeric", "2225", "exactly 2.225 euros", True),
        ("numeric", "2225", "exactly 2,225 euros", True),
        ("date_string", "2018-03-05", "in March", True),
        ("date_string", "2018-03-05", "on day 5", True),
        ("date_string", "2018-03-05", "in April 2019", False),
        ("year_pattern", "2016", "during 2016", True),
    ],
)
def test_value_named(ask, kind, value, question, want):
    lit = F.struct(F.col("v").alias("literal"), F.lit(kind).alias("value_type"))
    assert ask(X.value_named(lit, F.col("q")), v=value, q=question) == want


def test_names_and_cues(ask):
    assert ask(X.names_column(F.col("q"), "resource"), q="Which budget owner approved?")
    assert not ask(X.names_column(F.col("q"), "resource"), q="Which pre-approver?")  # tokens have no hyphen
    assert not ask(X.names_column(F.col("q"), "activity"), q="preactivity")
    assert ask(X.has_cue(F.col("q"), "COUNT"), q="How many?")
    assert not ask(X.has_cue(F.col("q"), "SUM"), q="aggregate it")
    assert ask(X.has_cue(F.col("q"), "Temporal"), q="dismayed")  # the month list binds at its ends only


def test_names(ask):
    assert ask(T.slugify(F.col("x")), x="Qwen2.5-7B / Instruct!") == "qwen2_5_7b_instruct"
    assert ask(T.slugify(F.col("x")), x="--") == "unknown"
    assert ask(T.model_slug(F.col("x")), x="Qwen/Qwen2.5-7B") == "qwen2_5_7b"
    assert ask(T.experiment_name(F.lit("local"), F.col("x"), F.lit("lf"), F.lit(None).cast("string")), x="oss_m") == "oss_m_lf"
    assert ask(T.experiment_name(F.lit("local"), F.col("x"), F.lit("lf"), F.lit("run 2")), x="a/m") == "oss_m_lf_run_2"
    assert ask(T.group_of(F.col("x")), x="12_3") == "12"
    assert ask(T.scores_filename(F.col("x"), F.lit("EX")), x="a/M-1") == "scores_opr_m_1_EX.tsv"


@pytest.mark.parametrize("values", [[], [2.5], [1.0, 2.0], [-3.0, None, 7.0, 7.0, -3.0, 0.0], [1.0, float("nan"), float("nan")], [float(x % 13) for x in range(1000)]])
def test_describe_of_awkward_values(spark, values):
    got = corpus.describe(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    seen = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    middle = (seen[(len(seen) - 1) // 2] + seen[len(seen) // 2]) / 2 if seen else None
    assert got["n"] == len(seen) and (got["median"] == middle or str(got["median"]) == str(middle))


@pytest.mark.parametrize("kw", [{}, {"cot": True}, {"prefix": "SELECT "}])
def test_an_answer_is_cleaned_once_a_row(spark, kw):
    """Each step stands once in the plan; it was written out anew wherever the next one read it."""
    df = spark.range(1).select(F.col("id").cast("string").alias("x")).select(X.clean_sql(F.col("x"), **kw).alias("sql"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("im_end") == 1 and plan.count("insert|update") == 1
