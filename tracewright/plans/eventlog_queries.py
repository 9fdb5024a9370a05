"""Queries of the event log, each with the SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocabulary import Vocabulary
from ..operators import eventlog as E
from ..operators.order import numbered
from .eventlog_sql import DUCK_LOG, event_log

QUERIES: dict = {}
ORACLES: dict = {}

_L = f"event_log AS ({DUCK_LOG})"


def _add(name: str, make, sql: str) -> None:
    QUERIES[f"el_{name}"] = lambda spark, sf_dir: make(event_log(spark, sf_dir))
    ORACLES[f"el_{name}"] = f"WITH {_L}{sql if sql.startswith(',') else ' ' + sql}"


def _where(name: str, condition, sql: str) -> None:
    _add(f"filter_{name}", lambda log: log.where(condition()).select("id", "activity", "resource"), f"SELECT id, activity, resource FROM event_log WHERE {sql}")


_n = lambda: F.count("*").alias("n")
_r = lambda c, k=6: F.round(c, k)
# the order itself as a column, as results are compared without one
_placed = lambda df, *order: numbered(df, *order).withColumnRenamed("i", "place")

# F: filters and projections
_where("activity", lambda: E.has_activity("purchase"), "activity = 'purchase'")
_where("matches", lambda: E.activity_matches("IG"), "activity ILIKE '%ig%'")
_where("starts", lambda: E.activity_starts_with("p"), "activity ILIKE 'p%'")
_where("ends", lambda: E.activity_ends_with("k"), "activity ILIKE '%k'")
_where("resource", lambda: E.performed_by("r3"), "resource = 'r3'")
_where("resource_null", E.resource_undefined, "resource IS NULL")
_where("resource_known", E.resource_defined, "resource IS NOT NULL")
_where("cost_known", E.cost_known, "cost IS NOT NULL")
_where("cost_unknown", E.cost_unknown, "cost IS NULL")
_where("cost_gt", lambda: E.cost_is("gt", 100.0), "cost > 100")
_where("cost_gte", lambda: E.cost_is("gte", 100.0), "cost >= 100")
_where("cost_lt", lambda: E.cost_is("lt", 10.0), "cost < 10")
_where("cost_lte", lambda: E.cost_is("lte", 10.0), "cost <= 10")
_where("cost_eq", lambda: E.cost_is("eq", 5.0), "cost = 5")
_where("cost_between", lambda: E.cost_between(20.0, 40.0), "cost BETWEEN 20 AND 40")
_where("before", lambda: E.time_before("2024-01-05"), "timestamp < TIMESTAMP '2024-01-05'")
_where("after", lambda: E.time_after("2024-01-25 12:00:00"), "timestamp > TIMESTAMP '2024-01-25 12:00:00'")
_where("time_in", lambda: E.time_in("2024-01-05", "2024-01-06"), "timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
_where("in_year", lambda: E.in_year(2024), "timestamp BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2025-01-01'")
_where("in_month", lambda: E.in_month(2024, 1), "strftime(timestamp, '%Y-%m') = '2024-01'")
_where("on_day", lambda: E.on_day("2024-01-07"), "strftime(timestamp, '%Y-%m-%d') = '2024-01-07'")
_where("year_prefix", lambda: E.year_prefix(2024), "CAST(timestamp AS VARCHAR) LIKE '2024%'")
_where("case", lambda: E.in_case("case 7"), "idcase = 'case 7'")
_where("mixed", lambda: E.performed_by("r1") & (E.has_activity("view") | E.cost_is("gt", 50.0)), "resource = 'r1' AND (activity = 'view' OR cost > 50)")
_where("not_equal", lambda: F.col("resource") != "r3", "resource <> 'r3'")
_where("any_of", lambda: E.activity_in("view", "click"), "activity IN ('view', 'click')")
_where("not_matching", lambda: ~E.activity_matches("e"), "activity NOT ILIKE '%e%'")
# without case by the column's different values, as a list that reaches the files
_nocase = lambda log, part: part(Vocabulary.of(log, "activity", "resource"))
_add("nocase_like", lambda log: log.where(_nocase(log, lambda k: k.like("activity", "%IG%"))).select("id", "activity"), "SELECT id, activity FROM event_log WHERE activity ILIKE '%ig%'")
_add("nocase_equal", lambda log: log.where(_nocase(log, lambda k: k.equals("activity", "PURCHASE") & ~k.equals("resource", "R3"))).select("id", "resource"), "SELECT id, resource FROM event_log WHERE lower(activity) = 'purchase' AND lower(resource) <> 'r3'")
_add("project", lambda log: log.select("idcase", "activity", "id"), "SELECT idcase, activity, id FROM event_log")
_add("project_alias", lambda log: log.select("id", (F.col("cost") * 2).alias("End trip")), "SELECT id, cost * 2 AS \"End trip\" FROM event_log")
_add("coalesce", lambda log: log.select("id", F.coalesce("resource", F.lit("nobody")).alias("resource")), "SELECT id, coalesce(resource, 'nobody') AS resource FROM event_log")
_add("label", lambda log: log.select("id", F.lit("event").alias("kind")), "SELECT id, 'event' AS kind FROM event_log")
_add("distinct", lambda log: E.entity(log, "resource"), "SELECT DISTINCT resource FROM event_log")
_add("cte", lambda log: log.where(E.cost_known()).groupBy("activity").agg(_n()), ", known AS (SELECT * FROM event_log WHERE cost IS NOT NULL) SELECT activity, count(*) AS n FROM known GROUP BY activity")
_add("entity_case_having", lambda log: E.entity(log, "daycase", E.has_activity("view"), F.col("n") >= 2, n=F.count("*")), "SELECT daycase, count(*) AS n FROM event_log WHERE activity = 'view' GROUP BY daycase HAVING count(*) >= 2")
_add("limit_ordered", lambda log: log.select("id", "activity").orderBy("id").limit(10), "SELECT id, activity FROM event_log ORDER BY id LIMIT 10")

# A: aggregates
_add("count", lambda log: log.agg(_n()), "SELECT count(*) AS n FROM event_log")
_add("count_by_activity", lambda log: log.groupBy("activity").agg(_n()), "SELECT activity, count(*) AS n FROM event_log GROUP BY activity")
_add("count_by_two", lambda log: log.groupBy("activity", "resource").agg(_n()), "SELECT activity, resource, count(*) AS n FROM event_log GROUP BY ALL")
_add("count_distinct", lambda log: log.groupBy("activity").agg(F.countDistinct("resource").alias("n"), F.countDistinct("idcase").alias("cases")), "SELECT activity, count(DISTINCT resource) AS n, count(DISTINCT idcase) AS cases FROM event_log GROUP BY activity")
_add("count_column", lambda log: log.groupBy("activity").agg(F.count("cost").alias("n")), "SELECT activity, count(cost) AS n FROM event_log GROUP BY activity")
_add("sum_avg_min_max", lambda log: log.groupBy("resource").agg(_r(F.sum("cost"), 4).alias("s"), _r(F.avg("cost")).alias("a"), F.min("cost").alias("lo"), F.max("cost").alias("hi"), _n()), "SELECT resource, round(sum(cost), 4) AS s, round(avg(cost), 6) AS a, min(cost) AS lo, max(cost) AS hi, count(*) AS n FROM event_log GROUP BY resource")
_add("nested_average", lambda log: log.groupBy("daycase").agg(_n()).agg(_r(F.avg("n")).alias("a")), "SELECT round(avg(n), 6) AS a FROM (SELECT count(*) AS n FROM event_log GROUP BY daycase)")
_add("size_histogram", lambda log: log.groupBy("daycase").agg(F.count("*").alias("size")).groupBy("size").agg(_n()), "SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM event_log GROUP BY daycase) GROUP BY size")
_add("having_sum", lambda log: E.entity(log, "idcase", None, F.col("s") > 1000, s=F.round(F.sum("cost"), 4)), "SELECT idcase, round(sum(cost), 4) AS s FROM event_log GROUP BY idcase HAVING round(sum(cost), 4) > 1000")
_add("having_min", lambda log: E.entity(log, "daycase", None, F.col("t") > F.lit("2024-01-20").cast("timestamp_ntz"), t=F.min("timestamp")).select("daycase"), "SELECT daycase FROM event_log GROUP BY daycase HAVING min(timestamp) > TIMESTAMP '2024-01-20'")
_add("argmax_ties", lambda log: E.argmax_ties(log, "daycase", F.count("*")), ", g AS (SELECT daycase, count(*) AS m FROM event_log GROUP BY daycase) SELECT daycase, m FROM g WHERE m = (SELECT max(m) FROM g)")
_add("argmin_ties", lambda log: E.argmax_ties(log, "daycase", F.count("*"), least=True), ", g AS (SELECT daycase, count(*) AS m FROM event_log GROUP BY daycase) SELECT daycase, m FROM g WHERE m = (SELECT min(m) FROM g)")
_add("topn_ties", lambda log: E.top_ties(log, "daycase", F.count("*"), 5), ", g AS (SELECT daycase, count(*) AS m FROM event_log GROUP BY daycase) SELECT daycase, m FROM g WHERE m IN (SELECT m FROM g ORDER BY m DESC LIMIT 5)")
_add("bottomn_ties", lambda log: E.top_ties(log, "resource", F.count("*"), 3, least=True), ", g AS (SELECT resource, count(*) AS m FROM event_log GROUP BY resource) SELECT resource, m FROM g WHERE m IN (SELECT m FROM g ORDER BY m LIMIT 3)")
_add("threshold_groups", lambda log: log.join(log.groupBy("daycase").agg(_n()).where("n >= 4"), "daycase", "left_semi").agg(F.countDistinct("resource").alias("n")), "SELECT count(DISTINCT resource) AS n FROM event_log WHERE daycase IN (SELECT daycase FROM event_log GROUP BY daycase HAVING count(*) >= 4)")
_add("solely_by", lambda log: E.solely_by(log, case="daycase"), "SELECT daycase, min(resource) AS resource FROM event_log GROUP BY daycase HAVING count(DISTINCT resource) = 1")
_add("solely_by_named", lambda log: E.solely_by(log, "r4", case="daycase"), "SELECT daycase, min(resource) AS resource FROM event_log GROUP BY daycase HAVING count(DISTINCT resource) = 1 AND min(resource) = 'r4'")
_add("first_activity", lambda log: E.first_event(log, "activity", case="daycase"), "SELECT daycase, arg_min(activity, (timestamp, id)) AS activity FROM event_log GROUP BY daycase")
_add("last_activity", lambda log: E.last_event(log, "activity", case="daycase"), "SELECT daycase, arg_max(activity, (timestamp, id)) AS activity FROM event_log GROUP BY daycase")
_add("started_with", lambda log: E.first_event(log, "activity", case="daycase").where(E.has_activity("signup")).agg(_n()), "SELECT count(*) AS n FROM (SELECT daycase, arg_min(activity, (timestamp, id)) AS activity FROM event_log GROUP BY daycase) WHERE activity = 'signup'")
_add("any_value", lambda log: log.groupBy("daycase").agg(F.min("idcase").alias("idcase")), "SELECT daycase, any_value(idcase) AS idcase FROM event_log GROUP BY daycase")
_DUR = "epoch(date_trunc('second', max(timestamp)))::BIGINT - epoch(date_trunc('second', min(timestamp)))::BIGINT"
_add("case_duration", lambda log: E.case_duration(log, "daycase"), f"SELECT daycase, {_DUR} AS duration FROM event_log GROUP BY daycase")
_add("throughput_days", lambda log: E.throughput_days(log).select("idcase", _r("days").alias("days")), f"SELECT idcase, round(({_DUR}) / 86400.0, 6) AS days FROM event_log GROUP BY idcase")
_add("variant", lambda log: E.variants(log, "daycase"), "SELECT variant, count(*) AS cases FROM (SELECT string_agg(activity, ',' ORDER BY timestamp, id) AS variant FROM event_log GROUP BY daycase) GROUP BY variant")
_add("by_month", lambda log: log.groupBy(F.date_format("timestamp", "yyyy-MM").alias("month")).agg(_n()), "SELECT strftime(timestamp, '%Y-%m') AS month, count(*) AS n FROM event_log GROUP BY 1")
_add("by_day", lambda log: log.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(_n()), "SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS n FROM event_log GROUP BY 1")
_add("by_year_parts", lambda log: log.groupBy(F.year("timestamp").cast("long").alias("y"), F.lower(F.date_format("timestamp", "MMMM")).alias("month")).agg(_n()), "SELECT year(timestamp) AS y, lower(monthname(timestamp)) AS month, count(*) AS n FROM event_log GROUP BY ALL")
_add("julianday", lambda log: log.select("id", _r(E.seconds("timestamp") / 86400.0 + 2440587.5, 6).alias("jd")), "SELECT id, round(floor(epoch(timestamp)) / 86400.0 + 2440587.5, 6) AS jd FROM event_log")
_add("min_max_time", lambda log: log.groupBy("activity").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")), "SELECT activity, min(timestamp) AS lo, max(timestamp) AS hi FROM event_log GROUP BY activity")
_add("rework", lambda log: E.rework(log, "daycase"), "SELECT daycase, CAST(count(*) - count(DISTINCT activity) AS BIGINT) AS rework FROM event_log GROUP BY daycase")
_add("value_counts", lambda log: _placed(log.groupBy("resource").agg(_n()), F.desc("n"), F.asc_nulls_first("resource")), "SELECT resource, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, resource NULLS FIRST) - 1 AS place FROM event_log GROUP BY resource")
_add("overall_row", lambda log: log.rollup("activity").agg(_n()).select(F.coalesce("activity", F.lit("OVERALL")).alias("activity"), "n"), "SELECT coalesce(activity, 'OVERALL') AS activity, count(*) AS n FROM event_log GROUP BY ROLLUP (activity)")
_add("percent_guarded", lambda log: log.groupBy("activity").agg(_r(100 * F.coalesce(F.try_divide(F.count("resource"), F.count("*")), F.lit(0.0)), 2).alias("pct")), "SELECT activity, round(100 * coalesce(count(resource)::DOUBLE / nullif(count(*), 0), 0), 2) AS pct FROM event_log GROUP BY activity")

# J: joins
_add("events_after", lambda log: E.events_after(log, "purchase", "daycase", "id", case="daycase"), "SELECT e1.daycase, e1.id FROM event_log e1 JOIN event_log e2 ON e1.daycase = e2.daycase WHERE e2.activity = 'purchase' AND e1.timestamp > e2.timestamp")
_add("events_before", lambda log: E.events_before(log, "purchase", "daycase", "id", case="daycase"), "SELECT e1.daycase, e1.id FROM event_log e1 JOIN event_log e2 ON e1.daycase = e2.daycase WHERE e2.activity = 'purchase' AND e1.timestamp < e2.timestamp")
_add("events_after_count", lambda log: E.events_after_count(log, "error"), "SELECT e1.idcase, count(*) AS n FROM event_log e1 JOIN event_log e2 ON e1.idcase = e2.idcase WHERE e2.activity = 'error' AND e1.timestamp > e2.timestamp GROUP BY e1.idcase")
_add("precedes", lambda log: E.precedes(log, "signup", "purchase", "daycase").agg(_n()), "SELECT count(DISTINCT e1.daycase) AS n FROM event_log e1 JOIN event_log e2 ON e1.daycase = e2.daycase WHERE e1.activity = 'signup' AND e2.activity = 'purchase' AND e1.timestamp < e2.timestamp")
_add("elapsed", lambda log: E.elapsed_between(log, "view", "purchase", "daycase"), "SELECT e1.daycase, floor(epoch(e2.timestamp))::BIGINT - floor(epoch(e1.timestamp))::BIGINT AS elapsed FROM event_log e1 JOIN event_log e2 ON e1.daycase = e2.daycase AND e2.timestamp > e1.timestamp WHERE e1.activity = 'view' AND e2.activity = 'purchase'")
_add("join_case_start", lambda log: log.join(log.groupBy("daycase").agg(F.min("timestamp").alias("start")), "daycase").where(F.col("timestamp") == F.col("start")).groupBy("activity").agg(_n()), "SELECT activity, count(*) AS n FROM event_log e JOIN (SELECT daycase, min(timestamp) AS start FROM event_log GROUP BY daycase) s ON s.daycase = e.daycase AND s.start = e.timestamp GROUP BY activity")
_add("since_start", lambda log: E.since_start(log, "view", "error", case="daycase"), "SELECT daycase, floor(epoch(min(timestamp) FILTER (activity = 'view')))::BIGINT - floor(epoch(min(timestamp)))::BIGINT AS view, floor(epoch(min(timestamp) FILTER (activity = 'error')))::BIGINT - floor(epoch(min(timestamp)))::BIGINT AS error FROM event_log GROUP BY daycase")
_add("semi_join", lambda log: log.join(log.where(E.cost_is("gt", 300.0)).select("idcase"), "idcase", "left_semi").groupBy("activity").agg(_n()), "SELECT activity, count(*) AS n FROM event_log WHERE idcase IN (SELECT idcase FROM event_log WHERE cost > 300) GROUP BY activity")
_add("lacks", lambda log: E.lacks(log, E.has_activity("purchase"), "daycase"), "SELECT DISTINCT daycase FROM event_log WHERE daycase NOT IN (SELECT daycase FROM event_log WHERE activity = 'purchase')")
_add("not_exists", lambda log: E.following(log, "activity", case="daycase").where("next_activity is null").groupBy("activity").agg(_n()), "SELECT activity, count(*) AS n FROM event_log e WHERE NOT EXISTS (SELECT 1 FROM event_log f WHERE f.daycase = e.daycase AND (f.timestamp, f.id) > (e.timestamp, e.id)) GROUP BY activity")
_add("scalar_subquery", lambda log: log.join(F.broadcast(log.agg(F.avg("cost").alias("mean"))), F.col("cost") > F.col("mean")).groupBy("activity").agg(_n()), "SELECT activity, count(*) AS n FROM event_log WHERE cost > (SELECT avg(cost) FROM event_log) GROUP BY activity")

# W: windows
_add("directly_follows", E.directly_follows, "SELECT activity, next_activity, count(*) AS n FROM (SELECT activity, lead(activity) OVER (PARTITION BY idcase ORDER BY timestamp, id) AS next_activity FROM event_log) WHERE next_activity IS NOT NULL GROUP BY ALL")
_add("service_duration", lambda log: E.service_duration(log, "daycase").select("id", F.coalesce("service", F.lit(-1)).alias("service")), "SELECT id, coalesce(floor(epoch(lead(timestamp) OVER w))::BIGINT - floor(epoch(timestamp))::BIGINT, -1) AS service FROM event_log WINDOW w AS (PARTITION BY daycase ORDER BY timestamp, id)")
_add("consecutive_repeat", lambda log: E.consecutive_repeat(log, case="daycase"), "SELECT DISTINCT daycase FROM (SELECT daycase, activity, lead(activity) OVER (PARTITION BY daycase ORDER BY timestamp, id) AS nxt FROM event_log) WHERE activity = nxt")
_add("consecutive_repeat_other", lambda log: E.consecutive_repeat(log, True, "daycase"), "SELECT DISTINCT daycase FROM (SELECT daycase, activity, resource, lead(activity) OVER w AS nxt, lead(resource) OVER w AS nr FROM event_log WINDOW w AS (PARTITION BY daycase ORDER BY timestamp, id)) WHERE activity = nxt AND resource <> nr")
_add("follows_given", lambda log: E.following(log, "activity", case="idcase").where(E.has_activity("signup") & (F.col("next_activity") == "purchase")).select("idcase", "id"), "SELECT idcase, id FROM (SELECT idcase, id, activity, lead(activity) OVER (PARTITION BY idcase ORDER BY timestamp, id) AS nxt FROM event_log) WHERE activity = 'signup' AND nxt = 'purchase'")

# the same with cases of more than 40 events cut into slices, as for logs whose cases don't fit a task
_sliced = lambda log, *cols: E.following(log, *cols, slice_rows=40)
_add("following_sliced", lambda log: _sliced(log, "activity", "timestamp").select("id", F.coalesce("next_activity", F.lit("-")).alias("next_activity"), F.coalesce(E.seconds("next_timestamp"), F.lit(-1)).alias("next_second")), "SELECT id, coalesce(lead(activity) OVER w, '-') AS next_activity, coalesce(floor(epoch(lead(timestamp) OVER w))::BIGINT, -1) AS next_second FROM event_log WINDOW w AS (PARTITION BY idcase ORDER BY timestamp, id)")
_add("directly_follows_sliced", lambda log: E.directly_follows(log, slice_rows=40), ORACLES["el_directly_follows"].removeprefix(f"WITH {_L} "))
_add("variant_sliced", lambda log: E.variants(log, "idcase", slice_rows=40), "SELECT variant, count(*) AS cases FROM (SELECT string_agg(activity, ',' ORDER BY timestamp, id) AS variant FROM event_log GROUP BY idcase) GROUP BY variant")

# O: top-k of values, dropping ties by id
_add("top_limit", lambda log: log.where(E.cost_known()).select("id", "cost").orderBy(F.desc("cost"), "id").limit(7), "SELECT id, cost FROM event_log WHERE cost IS NOT NULL ORDER BY cost DESC, id LIMIT 7")
_add("top_values", lambda log: log.join(log.where(E.cost_known()).select("cost").distinct().orderBy(F.desc("cost")).limit(5), "cost", "left_semi").select("id", "cost"), "SELECT id, cost FROM event_log WHERE cost IN (SELECT DISTINCT cost FROM event_log WHERE cost IS NOT NULL ORDER BY cost DESC LIMIT 5)")
_add("distinct_sorted_by_other", lambda log: _placed(log.groupBy("activity").agg(F.min("timestamp").alias("t")), "t", "activity").drop("t"), "SELECT activity, row_number() OVER (ORDER BY min(timestamp), activity) - 1 AS place FROM event_log GROUP BY activity")
_add("sorted", lambda log: _placed(log.select("id", "cost"), F.asc_nulls_first("cost"), F.desc("id")), "SELECT id, cost, row_number() OVER (ORDER BY cost NULLS FIRST, id DESC) - 1 AS place FROM event_log")
_add("order_in_subquery", lambda log: log.orderBy("cost").groupBy("activity").agg(_n()), "SELECT activity, count(*) AS n FROM (SELECT * FROM event_log ORDER BY cost) GROUP BY activity")

# S: sets
_add("union_metrics", lambda log: E.union_of(log, views=E.has_activity("view"), known=E.cost_known(), r3=E.performed_by("r3")), "SELECT count(*) AS n, 'views' AS grp FROM event_log WHERE activity = 'view' UNION SELECT count(*), 'known' FROM event_log WHERE cost IS NOT NULL UNION SELECT count(*), 'r3' FROM event_log WHERE resource = 'r3'")
_add("both", lambda log: E.satisfies_both(log, E.has_activity("view"), E.performed_by("r2"), "daycase"), "SELECT daycase FROM event_log WHERE activity = 'view' INTERSECT SELECT daycase FROM event_log WHERE resource = 'r2'")
_add("excludes", lambda log: E.excludes(log, E.has_activity("view"), E.has_activity("error"), "daycase"), "SELECT daycase FROM event_log WHERE activity = 'view' EXCEPT SELECT daycase FROM event_log WHERE activity = 'error'")
_add("all_cost_null", lambda log: E.all_cost_null(log, "daycase"), "SELECT daycase FROM event_log WHERE cost IS NULL EXCEPT SELECT daycase FROM event_log WHERE cost IS NOT NULL")
_add("both_but_not", lambda log: E.both_but_not(log, E.has_activity("view"), E.has_activity("click"), E.has_activity("error"), "daycase"), "(SELECT daycase FROM event_log WHERE activity = 'view' INTERSECT SELECT daycase FROM event_log WHERE activity = 'click') EXCEPT SELECT daycase FROM event_log WHERE activity = 'error'")
