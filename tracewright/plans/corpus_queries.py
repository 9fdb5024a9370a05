"""Queries of text measures, SQL text and corpus stages, each with the SQL that DuckDB runs.

Utterances: turns of conversations are paraphrases of a group (turn 0 the anchor); questions with gold
SQL are derived from events and parts by expressions that both engines share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sqltext as X
from ..functions import text as T
from ..operators import corpus as C

QUERIES: dict = {}
ORACLES: dict = {}

_TOKS = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]', '', 'g'), '\\s+'), lambda t: t <> '')"


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(F.col("conv_id").alias("group_id"), F.col("turn").alias("position"), F.col("text").alias("question"), F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("utterance_id"))


# Gold SQL and a question for each event, out of its columns. {s}: the engine's text type.
_QUESTIONS = """
SELECT event_id AS id, concat(CAST(event_id % 40 AS {s}), '_', CAST(event_id AS {s})) AS utterance_id, CAST(event_id % 40 AS {s}) AS group_id,
  CASE event_id % 6
    WHEN 0 THEN concat('How many ', event_type, ' events cost more than ', CAST(user_id AS {s}), '?')
    WHEN 1 THEN concat('List the different cases of employee r', CAST(user_id AS {s}), ' in January 2024')
    WHEN 2 THEN 'What is the total expense per activity, except errors?'
    WHEN 3 THEN concat('When did the trip case ', CAST(user_id AS {s}), ' start?')
    WHEN 4 THEN 'Which person had the most events in 2024'
    ELSE 'cases with both a view but not a purchase' END AS question,
  CASE event_id % 6
    WHEN 0 THEN concat('SELECT COUNT(*) FROM event_log WHERE activity = ''', event_type, ''' AND cost > ', CAST(user_id AS {s}))
    WHEN 1 THEN concat('SELECT  DISTINCT idcase FROM event_log WHERE resource = "r', CAST(user_id AS {s}), '" AND timestamp BETWEEN ''2024-01-01'' AND ''2024-02-01''')
    WHEN 2 THEN 'SELECT activity, SUM(cost) AS total FROM event_log WHERE activity != ''error'' GROUP BY activity'
    WHEN 3 THEN concat('SELECT MIN(timestamp) FROM event_log WHERE idcase = ''case ', CAST(user_id AS {s}), '''')
    WHEN 4 THEN 'SELECT resource FROM event_log WHERE timestamp LIKE ''2024%'' GROUP BY resource HAVING COUNT(*) = (SELECT MAX(m) FROM (SELECT COUNT(*) AS m FROM event_log GROUP BY resource))'
    ELSE 'SELECT idcase FROM event_log WHERE activity = ''view'' EXCEPT SELECT idcase FROM event_log WHERE activity = ''purchase''' END AS gold_sql
FROM {events}
"""
_Q = _QUESTIONS.format(s="VARCHAR", events="events")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_QUESTIONS.format(s="STRING", events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def _turns(name: str, make, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(utterances(spark, sf_dir))
    if sql:
        ORACLES[name] = f"WITH u AS (SELECT conv_id AS group_id, turn AS position, {_TOKS} AS toks FROM conversations) {sql}"


def _asked(name: str, make, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(questions(spark, sf_dir))
    if sql:
        ORACLES[name] = f"WITH q AS ({_Q}){sql if sql.startswith(',') else ' ' + sql}"


_turns("tx_tokens", lambda u: u.select("group_id", "position", F.array_join(T.tokens("question"), " ").alias("toks")), "SELECT group_id, position, array_to_string(toks, ' ') AS toks FROM u")
_turns("tx_ttr", lambda u: u.select("group_id", "position", F.round(T.ttr(T.tokens("question")), 6).alias("ttr")), "SELECT group_id, position, round(coalesce(len(list_distinct(toks))::DOUBLE / nullif(len(toks), 0), 0), 6) AS ttr FROM u")
_turns("tx_jaccard", lambda u: C.anchor_pairs(u).drop("share"), "SELECT v.group_id, v.position, round(coalesce(len(list_intersect(a.toks, v.toks))::DOUBLE / nullif(len(list_distinct(list_concat(a.toks, v.toks))), 0), 0), 6) AS jaccard_similarity FROM u v JOIN u a ON a.group_id = v.group_id AND a.position = 0 WHERE v.position > 0")
_turns("tx_jaccard_means", C.jaccard_means, "SELECT a.group_id, count(v.position) AS n_comparisons, round(avg(len(list_intersect(a.toks, v.toks))::DOUBLE / nullif(len(list_distinct(list_concat(a.toks, v.toks))), 0)), 6) AS mean_jaccard FROM u a LEFT JOIN u v ON v.group_id = a.group_id AND v.position > 0 WHERE a.position = 0 GROUP BY a.group_id")
_turns("tx_describe", lambda u: C.describe(C.anchor_pairs(u), "jaccard_similarity"), "SELECT round(avg(j), 6) AS mean, round(median(j), 6) AS median, round(stddev_samp(j), 6) AS sd, min(j) AS min, max(j) AS max, count(*) AS n FROM (SELECT round(coalesce(len(list_intersect(a.toks, v.toks))::DOUBLE / nullif(len(list_distinct(list_concat(a.toks, v.toks))), 0), 0), 6) AS j FROM u v JOIN u a ON a.group_id = v.group_id AND a.position = 0 WHERE v.position > 0)")
_turns("tx_quartiles", lambda u: C.quartiles(C.anchor_pairs(u), "jaccard_similarity"), "SELECT s[len(s) // 4 + 1] AS q1, s[3 * len(s) // 4 + 1] AS q3 FROM (SELECT list_sort(list(round(coalesce(len(list_intersect(a.toks, v.toks))::DOUBLE / nullif(len(list_distinct(list_concat(a.toks, v.toks))), 0), 0), 6))) AS s FROM u v JOIN u a ON a.group_id = v.group_id AND a.position = 0 WHERE v.position > 0)")
_turns("tx_group_lexical", lambda u: C.lexical_diversity(u).drop("mtld"), "SELECT group_id, count(*) AS n_utterances, len(flatten(list(toks))) AS n_tokens, len(list_distinct(flatten(list(toks)))) AS n_types, round(len(list_distinct(flatten(list(toks))))::DOUBLE / len(flatten(list(toks))), 6) AS ttr FROM u GROUP BY group_id")
_turns("tx_corpus_lexical", C.corpus_diversity, "SELECT count(*) AS n_tokens, count(DISTINCT t) AS n_types, round(count(DISTINCT t)::DOUBLE / count(*), 6) AS ttr FROM (SELECT unnest(toks) AS t FROM u)")
# the fold of each group's tokens, forwards and backwards, a token a round
_MTLD = """, g AS (SELECT group_id, flatten(list(toks ORDER BY position)) AS toks FROM u GROUP BY group_id
), d AS (SELECT group_id, 1 AS dir, toks FROM g UNION ALL SELECT group_id, 2, list_reverse(toks) FROM g
), r(group_id, dir, i, n, seen, f) AS (
  SELECT group_id, dir, 0, 0, CAST([] AS VARCHAR[]), 0 FROM d
  UNION ALL
  SELECT group_id, dir, i + 1, CASE WHEN hit THEN 0 ELSE n + 1 END, CASE WHEN hit THEN CAST([] AS VARCHAR[]) ELSE more END, f + CAST(hit AS INT) FROM (
    SELECT *, len(more)::DOUBLE / (n + 1) <= 0.72::DOUBLE AS hit FROM (
      SELECT r.*, CASE WHEN list_contains(seen, toks[i + 1]) THEN seen ELSE list_append(seen, toks[i + 1]) END AS more FROM r JOIN d ON d.group_id = r.group_id AND d.dir = r.dir WHERE i < len(toks)))
), e AS (
  SELECT d.group_id, len(toks) AS n, f + CASE WHEN r.n > 0 THEN (1 - len(seen)::DOUBLE / r.n) / (1 - 0.72::DOUBLE) ELSE 0 END AS factors FROM r JOIN d ON d.group_id = r.group_id AND d.dir = r.dir WHERE i = len(toks)
) SELECT group_id, round(CASE WHEN max(n) < 2 OR avg(factors) = 0 THEN 0 ELSE max(n) / avg(factors) END, 4) AS mtld FROM e GROUP BY group_id"""
_turns("tx_mtld", lambda u: C.lexical_diversity(u).select("group_id", "mtld"), _MTLD)
ORACLES["tx_mtld"] = ORACLES["tx_mtld"].replace("WITH u AS", "WITH RECURSIVE u AS").replace(") , g AS", "), g AS")
# factor by factor; in this data none is as long as 4,000 tokens
_CORPUS_MTLD = """, f AS (SELECT unnest(toks) AS tok, unnest(range(len(toks))) AS i, group_id, position FROM u
), o AS (SELECT tok, row_number() OVER (ORDER BY CAST(group_id AS INT), position, i) - 1 AS pos, count(*) OVER () AS total FROM f
), b AS (SELECT 1 AS dir, pos, tok, total FROM o UNION ALL SELECT 2, total - 1 - pos, tok, total FROM o
), t AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY dir, tok ORDER BY pos), -1) AS prev FROM b
), r(dir, s, total, f) AS (
  SELECT DISTINCT dir, CAST(0 AS BIGINT), total, CAST(0 AS DOUBLE) FROM t
  UNION ALL
  SELECT dir, coalesce(e + 1, total), total, f + CASE WHEN e IS NULL THEN (1 - types / n) / (1 - 0.72::DOUBLE) ELSE 1 END FROM (
    SELECT dir, s, total, f, min(pos) FILTER (types / n <= 0.72::DOUBLE) AS e, max(types) AS types, max(n) AS n FROM (
      SELECT r.dir, r.s, r.total, r.f, t.pos, (t.pos - r.s + 1)::DOUBLE AS n, (sum(CASE WHEN t.prev < r.s THEN 1 ELSE 0 END) OVER (PARTITION BY r.dir ORDER BY t.pos))::DOUBLE AS types
      FROM r JOIN t ON t.dir = r.dir AND t.pos BETWEEN r.s AND r.s + 3999 WHERE r.s < r.total
    ) GROUP BY dir, s, total, f
  )
) SELECT round(max(total) / avg(f), 4) AS mtld FROM r WHERE s = total"""
_turns("tx_corpus_mtld", C.corpus_mtld, _CORPUS_MTLD)
ORACLES["tx_corpus_mtld"] = ORACLES["tx_corpus_mtld"].replace("WITH u AS", "WITH RECURSIVE u AS").replace(") , f AS", "), f AS")
_turns("tx_group_sizes", C.group_sizes, "SELECT round(avg(n), 6) AS mean, round(median(n), 6) AS median, round(stddev_samp(n), 6) AS sd, min(n) AS min, max(n) AS max, count(*) AS n FROM (SELECT count(*) AS n FROM u GROUP BY group_id)")
_turns("tx_positions", lambda u: C.positions(u.select("group_id", F.col("position").cast("string").alias("Utterance_id")), "group_id", "Utterance_id").select("group_id", "position", "utterance_id"), "SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY position) - 1 AS position, concat(group_id, '_', row_number() OVER (PARTITION BY group_id ORDER BY position) - 1) AS utterance_id FROM u")

_PLAIN = "regexp_replace(regexp_replace(gold_sql, '''[^'']*''', '''''', 'g'), '\"[^\"]*\"', '\"\"', 'g')"
_COLS = ", ".join(f"CASE WHEN regexp_matches(p, '(?i)\\b{c}\\b') THEN '{c}' END" for c in X.TARGET_COLUMNS)
_asked("sql_columns", lambda q: q.select("id", F.array_join(X.referenced_columns(F.col("gold_sql")), ";").alias("cols")), f", r AS (SELECT id, {_PLAIN} AS p FROM q) SELECT id, concat_ws(';', {_COLS}) AS cols FROM r")
_LITERALS = f"""s AS (
  SELECT *, regexp_extract_all(gold_sql, '''([^'']+)''', 1) AS a, regexp_extract_all(gold_sql, '"([^"]+)"', 1) AS b, regexp_extract_all({_PLAIN}, '\\b(\\d+(?:\\.\\d+)?)\\b', 1) AS c FROM q
), l AS (
  SELECT * EXCLUDE (a, b, c), list_concat(
    list_transform(a, lambda x: {{'v': CASE WHEN regexp_matches(x, '^\\d{{4}}%') THEN rtrim(x, '%') ELSE x END,
      't': CASE WHEN regexp_matches(x, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') OR regexp_matches(x, '^\\d{{4}}-\\d{{2}}$') THEN 'date_string' WHEN regexp_matches(x, '^\\d{{4}}%') THEN 'year_pattern' ELSE 'string' END}}),
    list_transform(b, lambda x: {{'v': x, 't': CASE WHEN regexp_matches(x, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'date_string' ELSE 'string' END}}),
    list_transform(c, lambda x: {{'v': x, 't': 'numeric'}})) AS ls FROM s
)"""
_asked(
    "sql_literals",
    lambda q: q.select("id", F.posexplode(X.literals(F.col("gold_sql"))).alias("place", "l")).select("id", "place", "l.literal", "l.value_type"),
    f", {_LITERALS} SELECT id, i - 1 AS place, ls[i].v AS literal, ls[i].t AS value_type FROM (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)",
)


def _value_named(v: str, t: str) -> str:
    """Whether the lower-cased question `low` names the value v of type t."""
    text, parts = f"trim(lower({v}))", f"string_split(trim(lower({v})), '-')"
    soft = lambda c: f"trim(regexp_replace({c}, '[''-]', ' ', 'g'))"
    part = lambda i: f"coalesce({parts}[{i}], '')"
    months = " OR ".join(f"({part(2)} = '{i:02d}' AND (contains(low, '{m}') OR contains(low, '{i}')))" for i, m in enumerate(X.MONTHS, 1))
    dated = f"contains(low, {text}) OR ({part(1)} <> '' AND contains(low, {part(1)})) OR {months} OR ({part(3)} <> '' AND contains(low, ltrim({part(3)}, '0')))"
    grouped = f"format('{{:,}}', TRY_CAST({v} AS BIGINT))"
    number = f"regexp_matches(low, '\\b' || replace({v}, '.', '\\.') || '\\b') OR (NOT contains({v}, '.') AND len({v}) >= 4 AND coalesce(contains(low, {grouped}) OR contains(low, replace({grouped}, ',', '.')), false))"
    return f"CASE {t} WHEN 'string' THEN contains(low, {text}) OR contains({soft('low')}, {soft(text)}) WHEN 'numeric' THEN {v} <> '1' AND ({number}) ELSE {dated} END"


_VALUES = f"{_LITERALS}, v AS (SELECT utterance_id, lower(question) AS low, unnest(ls) AS x FROM l), w AS (SELECT utterance_id, x.t AS value_type, {_value_named('x.v', 'x.t')} AS value_lexicalized FROM v WHERE NOT (x.t = 'numeric' AND x.v = '1'))"
_MARKS = ", ".join(f"regexp_matches(p, '{m}') AS \"{o}\"" for o, m in X.OPERATION_MARKS.items())
_asked("sql_operations", lambda q: q.withColumn("m", X.operations(F.col("gold_sql"))).select("id", *[F.col("m")[o].alias(o) for o in X.OPERATION_MARKS]), f", r AS (SELECT id, upper({_PLAIN}) AS p FROM q) SELECT id, {_MARKS} FROM r")
_CUES = ", ".join(f"regexp_matches(lower(question), '{'|'.join(f'(?:{p})' for p in ps)}') AS \"{o}\"" for o, ps in X.OPERATION_CUES.items())
_asked("sql_cues", lambda q: q.select("id", *[X.has_cue(F.col("question"), o).alias(o) for o in X.OPERATION_CUES]), f"SELECT id, {_CUES} FROM q")
_WORDS = "regexp_split_to_array(regexp_replace(lower(question), '[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]', '', 'g'), '\\s+')"


def _named(column: str) -> str:
    words = ", ".join(f"'{s}'" for s in X.COLUMN_SYNONYMS[column] if " " not in s)
    phrases = "".join(f" OR contains(lower(question), '{s}')" for s in X.COLUMN_SYNONYMS[column] if " " in s)
    return f"(list_has_any({_WORDS}, [{words}]){phrases})"


_asked("sql_named_columns", lambda q: q.select("id", *[X.names_column(F.col("question"), c).alias(c) for c in X.TARGET_COLUMNS]), "SELECT id, " + ", ".join(f"{_named(c)} AS {c}" for c in X.TARGET_COLUMNS) + " FROM q")
_COUNTED = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", regexp_matches(p, '(?i)\\b{c}\\b') AS r, {_named(c)} AS l FROM r" for c in X.TARGET_COLUMNS)
_asked(
    "sql_column_rates",
    lambda q: C.column_summary(C.column_rows(q)),
    f", r AS (SELECT id, question, {_PLAIN} AS p FROM q), c AS ({_COUNTED}) SELECT coalesce(\"column\", 'OVERALL') AS \"column\", count(*) FILTER (r) AS \"references\", count(*) FILTER (r AND l) AS lexicalized, count(*) FILTER (r AND NOT l) AS not_lexicalized, round(100 * coalesce(count(*) FILTER (r AND l)::DOUBLE / nullif(count(*) FILTER (r), 0), 0), 2) AS lexicalization_rate_pct FROM c GROUP BY ROLLUP (\"column\")",
)
_OPS = " UNION ALL ".join(f"SELECT '{o}' AS sql_operation, regexp_matches(p, '{m}') AS r, regexp_matches(lower(question), '{'|'.join(f'(?:{x})' for x in X.OPERATION_CUES[o])}') AS l FROM r" for o, m in X.OPERATION_MARKS.items())
_asked(
    "sql_operation_rates",
    lambda q: C.operation_summary(C.operation_rows(q)),
    f", r AS (SELECT id, question, upper({_PLAIN}) AS p FROM q), c AS ({_OPS}) SELECT coalesce(sql_operation, 'OVERALL') AS sql_operation, count(*) FILTER (r) AS occurrences, count(*) FILTER (r AND l) AS explicit_cue, count(*) FILTER (r AND NOT l) AS no_explicit_cue, round(100 * coalesce(count(*) FILTER (r AND l)::DOUBLE / nullif(count(*) FILTER (r), 0), 0), 2) AS lexicalization_rate_pct FROM c GROUP BY ROLLUP (sql_operation)",
)
_asked("sql_value_rows", lambda q: C.value_rows(q).groupBy("value_type", "value_lexicalized").agg(F.count("*").alias("n")), f", {_VALUES} SELECT value_type, value_lexicalized, count(*) AS n FROM w GROUP BY ALL")
_asked(
    "sql_value_summary",
    lambda q: C.value_summary(C.value_rows(q)),
    f", {_VALUES}, n AS (SELECT count(DISTINCT utterance_id) AS applicable_utterances, count(*) AS total_literal_instances, count(*) FILTER (value_lexicalized) AS n_lexicalized, count(*) FILTER (NOT value_lexicalized) AS n_not_lexicalized FROM w) "
    "SELECT *, round(coalesce(100 * n_lexicalized::DOUBLE / nullif(total_literal_instances, 0), 0), 2) AS pct_lexicalized, round(coalesce(100 * n_not_lexicalized::DOUBLE / nullif(total_literal_instances, 0), 0), 2) AS pct_not_lexicalized FROM n",
)
_LEVEL = f"""{_LITERALS}, m AS (
  SELECT *, list_filter(ls, lambda x: NOT (x.t = 'numeric' AND x.v = '1')) AS vs, lower(question) AS low,
    list_filter([{_COLS.replace("regexp_matches(p,", f"regexp_matches({_PLAIN},")}], lambda x: x IS NOT NULL) AS cols,
    list_filter([{', '.join(f"CASE WHEN {_named(c)} THEN '{c}' END" for c in X.TARGET_COLUMNS)}], lambda x: x IS NOT NULL) AS named,
    list_filter([{', '.join(f"CASE WHEN regexp_matches(upper({_PLAIN}), '{k}') THEN '{o}' END" for o, k in X.OPERATION_MARKS.items())}], lambda x: x IS NOT NULL) AS ops,
    list_filter([{', '.join(f"CASE WHEN regexp_matches(lower(question), '{'|'.join(f'(?:{p})' for p in ps)}') THEN '{o}' END" for o, ps in X.OPERATION_CUES.items())}], lambda x: x IS NOT NULL) AS cued FROM l
), h AS (
  SELECT utterance_id, count(*) FILTER ({_value_named('x.v', 'x.t')}) AS hits FROM (SELECT utterance_id, low, unnest(vs) AS x FROM m) GROUP BY utterance_id
), k AS (
  SELECT m.*, coalesce(hits, 0) AS hits, list_filter(cols, lambda x: list_contains(named, x)) AS both_cols, list_filter(ops, lambda x: list_contains(cued, x)) AS both_ops FROM m LEFT JOIN h ON h.utterance_id = m.utterance_id
) SELECT utterance_id, group_id, question, gold_sql, len(vs) AS val_n_literals, hits AS val_n_lexicalized, len(vs) > 0 AS val_applicable, array_to_string(cols, ';') AS cols_referenced, array_to_string(both_cols, ';') AS cols_lexicalized,
  len(cols) AS n_cols_referenced, len(both_cols) AS n_cols_lexicalized, array_to_string(ops, ';') AS ops_present, array_to_string(both_ops, ';') AS ops_with_cue, len(ops) AS n_ops_present, len(both_ops) AS n_ops_with_cue FROM k"""
_asked("sql_utterance_level", C.utterance_level, f", {_LEVEL}")
_asked("sql_validation", lambda q: C.validation(q.withColumn("position", F.col("id"))), "SELECT group_id, count(*) AS n_utterances, count(DISTINCT regexp_replace(lower(trim(gold_sql)), '\\s+', ' ', 'g')) AS n_distinct_gold_sql, count(DISTINCT regexp_replace(lower(trim(gold_sql)), '\\s+', ' ', 'g')) = 1 AS gold_sql_consistent, substr(arg_min(gold_sql, id), 1, 200) AS gold_sql_sample FROM q GROUP BY group_id")
_NORMAL = "rtrim(list_reduce(list_transform(string_split(regexp_replace(trim(gold_sql), ';+$', ''), ''''), lambda x, i: CASE WHEN i % 2 = 1 THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(x), '\\s+', ' ', 'g'), '\\s*,\\s*', ',', 'g'), '\\s+as\\s+\\w+', '', 'g'), 'count\\s*\\(\\s*\\w+\\s*\\)', 'count(*)', 'g') ELSE lower(x) END), lambda a, b: a || b))"
_asked("ev_normal_sql", lambda q: q.select("id", X.normal_sql(F.col("gold_sql")).alias("sql")), f"SELECT id, {_NORMAL} AS sql FROM q")
_asked("ev_order_by", lambda q: q.select("id", X.has_order_by(F.concat("gold_sql", F.when(F.col("id") % 2 == 0, " ORDER  BY 1").otherwise(""))).alias("ordered")), "SELECT id, id % 2 = 0 AS ordered FROM q")
_asked("ev_clean_sql", lambda q: q.select("id", X.clean_sql(F.concat(F.lit("Sure, here it is:\n```sql\n"), F.col("gold_sql"), F.lit(";\n```<|im_end|>\nuser"))).alias("sql")), "SELECT id, replace(gold_sql, 'SELECT  DISTINCT', 'SELECT DISTINCT') || ';' AS sql FROM q")
_asked("ev_clean_sql_cot", lambda q: q.select("id", X.clean_sql(F.concat(F.lit("First I count the events.\nFinal SQL:\n"), F.col("gold_sql"), F.lit(" ;\n")), cot=True).alias("sql")), "SELECT id, replace(gold_sql, 'SELECT  DISTINCT', 'SELECT DISTINCT') || ';' AS sql FROM q")
_asked("ev_clean_sql_prefix", lambda q: q.where("id % 6 < 4").select("id", X.clean_sql(F.substring("gold_sql", 8, 1000), prefix="SELECT ").alias("sql")), "SELECT id, replace(gold_sql, 'SELECT  DISTINCT', 'SELECT DISTINCT') || ';' AS sql FROM q WHERE id % 6 < 4")
_asked("sql_slug", lambda q: q.select("id", T.slugify(F.col("question")).alias("slug")), "SELECT id, trim(regexp_replace(lower(question), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM q")
_asked("sql_group_of", lambda q: q.select("id", T.group_of(F.col("utterance_id")).alias("g")), "SELECT id, group_id AS g FROM q")
