"""Every operation as a query over the test tables, with its SQL where SQL can express it."""

from __future__ import annotations

import tempfile

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import series as S
from ..operators import anomaly, classify, features, forecast
from ..sources import messages, tables
from ..streaming import windows
from .builder import Query

NOW = "2024-01-31 00:00:00"
QUERIES: dict = {}
SQL: dict[str, str] = {}
BY_USER = ["user_id"]


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def events(spark, d) -> DataFrame:
    return read(spark, d, "events")


def r(c, n=4):
    return F.round(c, n)


def simple(name: str, table: str, build, sql: str) -> None:
    query(name, sql)(lambda spark, d: build(read(spark, d, table)))


# Relational
simple("scan_project", "events", lambda e: e.select("event_id", "ts", "value"), "SELECT event_id, ts, value FROM events")
for _name, _cond, _sql in (
    ("filter_eq", lambda: F.col("event_type") == "click", "event_type = 'click'"),
    ("filter_ne", lambda: F.col("event_type") != "click", "event_type <> 'click'"),
    ("filter_range", lambda: (F.col("value") > 10) & (F.col("value") <= 50), "value > 10 AND value <= 50"),
    ("filter_like", lambda: F.col("event_type").like("%i%"), "event_type LIKE '%i%'"),
    ("filter_in", lambda: F.col("user_id").isin(1, 2, 3, 5, 8), "user_id IN (1, 2, 3, 5, 8)"),
    ("filter_between", lambda: F.col("value").between(20, 40), "value BETWEEN 20 AND 40"),
    ("filter_and_or_not", lambda: (F.col("event_type") == "click") & (F.col("value") > 50) | ~(F.col("user_id") < 100), "event_type = 'click' AND value > 50 OR NOT user_id < 100"),
):
    simple(_name, "events", lambda e, c=_cond: e.where(c()).select("event_id", "event_type", "user_id", "value"), f"SELECT event_id, event_type, user_id, value FROM events WHERE {_sql}")
simple("time_range_filter", "events", lambda e: Query(e, "ts").time_range("2024-01-10", "2024-01-12").columns("event_id", "ts").build(), "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
simple("time_since", "events", lambda e: Query(e, "ts").since("7d", NOW).columns("event_id", "ts").build(), f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
simple("sort_multi", "orders", lambda o: o.orderBy(F.col("o_orderdate").desc(), "o_orderkey").select("o_orderkey", "o_orderdate"), "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey")
simple("limit_topk", "events", lambda e: e.orderBy(F.col("value").desc(), "event_id").limit(25).select("event_id", "value"), "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
simple("union_all", "events", lambda e: Query(e).filter("value > 90").columns("event_id", "value").union(Query(e).filter("value < 30").columns("value", "event_id")).build(), "SELECT event_id, value FROM events WHERE value > 90 UNION ALL SELECT event_id, value FROM events WHERE value < 30")
simple("group_by_cols", "events", lambda e: e.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.max("value").alias("top")), "SELECT event_type, user_id, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")


def orders_customers(how):
    def run(spark, d):
        c, o = read(spark, d, "customer").select("c_custkey", "c_mktsegment"), read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").where("o_totalprice > 100000")
        return c.join(o, c.c_custkey == o.o_custkey, how)

    return run


for _name, _how, _sql in (
    ("join_inner", "inner", "SELECT c_custkey, c_mktsegment, o_orderkey, o_custkey, o_totalprice FROM customer JOIN o ON c_custkey = o_custkey"),
    ("join_left", "left", "SELECT c_custkey, c_mktsegment, o_orderkey, o_custkey, o_totalprice FROM customer LEFT JOIN o ON c_custkey = o_custkey"),
    ("join_right", "right", "SELECT c_custkey, c_mktsegment, o_orderkey, o_custkey, o_totalprice FROM customer RIGHT JOIN o ON c_custkey = o_custkey"),
    ("join_full", "full", "SELECT c_custkey, c_mktsegment, o_orderkey, o_custkey, o_totalprice FROM customer FULL JOIN o ON c_custkey = o_custkey"),
    ("join_semi", "left_semi", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)"),
    ("join_anti", "left_anti", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM o)"),
):
    query(_name, f"WITH o AS (SELECT * FROM orders WHERE o_totalprice > 100000) {_sql}")(orders_customers(_how))


@query("join_cross", "SELECT r_name, n_name FROM region, nation")
def join_cross(spark, d):
    # Both sides are fixed dimension tables of 5 and 25 rows.
    return read(spark, d, "region").select("r_name").crossJoin(read(spark, d, "nation").select("n_name"))


# Aggregates
simple("agg_count_sum_mean_min_max", "events", lambda e: e.groupBy("event_type").agg(F.count("value").alias("n"), r(F.sum("value"), 2).alias("total"), r(F.avg("value")).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")), "SELECT event_type, count(value) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
simple("agg_first_last", "events", lambda e: e.groupBy("user_id").agg(A.first(F.col("value"), F.col("ts")).alias("first"), A.last(F.col("value"), F.col("ts")).alias("last")), "SELECT user_id, min_by(value, ts) AS first, max_by(value, ts) AS last FROM events GROUP BY 1")


def rank_sql(p: float) -> str:
    return f"list_sort(list(value))[1 + cast(floor({p / 100} * (count(value) - 1) + 0.5) AS INT)]"


simple("agg_median_nearest", "events", lambda e: A.grouped(e, BY_USER, {}, {"median": ("value", 50)}), f"SELECT user_id, {rank_sql(50)} AS median FROM events GROUP BY 1")
simple("agg_percentiles", "events", lambda e: A.named(e, ["event_type"], {n: (n, "value") for n in ("p50", "p95", "p99", "p999")}, "ts"), f"SELECT event_type, {rank_sql(50)} AS p50, {rank_sql(95)} AS p95, {rank_sql(99)} AS p99, {rank_sql(99.9)} AS p999 FROM events GROUP BY 1")
simple("agg_percentile_by_rank", "events", lambda e: A.percentile_by_rank(e, ["event_type"], "value", 95, "p95"), f"SELECT event_type, {rank_sql(95)} AS p95 FROM events GROUP BY 1")
simple("agg_stddev_variance", "events", lambda e: e.groupBy("user_id").agg(r(A.stddev(F.col("value"))).alias("sd"), r(A.variance(F.col("value")), 3).alias("var")), "SELECT user_id, round(coalesce(stddev_samp(value), 0), 4) AS sd, round(coalesce(var_samp(value), 0), 3) AS var FROM events GROUP BY 1")
simple("agg_corr_covar", "lineitem", lambda x: x.groupBy("l_returnflag").agg(r(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr"), r(F.covar_samp("l_quantity", "l_discount"), 6).alias("covar")), "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS corr, round(covar_samp(l_quantity, l_discount), 6) AS covar FROM lineitem GROUP BY 1")


@query("agg_linear_regression", "SELECT user_id, round(regr_slope(value, x), 4) AS slope, round(regr_intercept(value, x), 3) AS intercept FROM (SELECT user_id, value, epoch_us(ts) / 86400000000.0 - 19723 AS x FROM events) GROUP BY 1")
def agg_linear_regression(spark, d):
    x = F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000.0 - 19723
    slope, intercept = A.linear_regression(F.col("value"), F.col("x"))
    return events(spark, d).withColumn("x", x).groupBy("user_id").agg(r(slope).alias("slope"), r(intercept, 3).alias("intercept"))


simple("agg_trend", "events", lambda e: e.groupBy("user_id").agg(A.trend(F.col("value"), F.col("ts"), 0.2).alias("trend")), "SELECT user_id, CASE WHEN s > 0.2 THEN 1 WHEN s < -0.2 THEN -1 ELSE 0 END AS trend FROM (SELECT user_id, CASE WHEN count(*) > 1 THEN (max_by(value, ts) - min_by(value, ts)) / (count(*) - 1) ELSE 0 END AS s FROM events GROUP BY 1)")
simple("column_stats", "events", lambda e: tables.column_stats(e, ["user_id", "event_type"]).select("column", "count", "null_count", "min", "max"), "SELECT 'user_id' AS \"column\", count(*) AS count, count(*) FILTER (user_id IS NULL) AS null_count, min(user_id)::VARCHAR AS min, max(user_id)::VARCHAR AS max FROM events UNION ALL SELECT 'event_type', count(*), count(*) FILTER (event_type IS NULL), min(event_type), max(event_type) FROM events")

# Buckets
for _w, _i in (("1m", "1 minute"), ("5m", "5 minutes"), ("1h", "1 hour"), ("1d", "1 day")):
    simple(f"bucket_mean_{_w}", "events", lambda e, w=_w: S.bucketed(e, "ts", w, [], mean=r(F.avg("value")), n=F.count("*")), f"SELECT time_bucket(INTERVAL '{_i}', ts, TIMESTAMP '1970-01-01') AS bucket, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY 1")
simple("bucket_multi_agg_by_tag", "events", lambda e: S.bucketed(e, "ts", "1d", ["event_type"], {"p95": ("value", 95)}, low=F.min("value"), high=F.max("value"), first=A.first(F.col("value"), F.col("ts")), last=A.last(F.col("value"), F.col("ts"))), f"SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS bucket, event_type, min(value) AS low, max(value) AS high, min_by(value, ts) AS first, max_by(value, ts) AS last, {rank_sql(95)} AS p95 FROM events GROUP BY 1, 2")
simple("bucket_rate_delta", "events", lambda e: S.bucketed(e, "ts", "1h", [], delta=r(A.delta(F.col("value"), F.col("ts"))), rate=r(A.rate(F.col("value"), F.col("ts")), 6)), "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS bucket, round(max_by(value, ts) - min_by(value, ts), 4) AS delta, round(CASE WHEN max(ts) > min(ts) THEN (max_by(value, ts) - min_by(value, ts)) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) ELSE 0 END, 6) AS rate FROM events GROUP BY 1")
simple("bucket_fill_spine", "events", lambda e: S.spine(S.bucketed(e, "ts", "6h", [], top=F.max("value")), "bucket", "6h"), "WITH b AS (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS bucket, max(value) AS top FROM events GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL '6 hours')) AS bucket) SELECT s.bucket, top FROM s LEFT JOIN b USING (bucket)")
simple("bucket_fill_spine_by_user", "events", lambda e: S.spine(S.bucketed(e, "ts", "6h", BY_USER, top=F.max("value")), "bucket", "6h", ("user_id",)), "WITH b AS (SELECT user_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS bucket, max(value) AS top FROM events GROUP BY 1, 2), s AS (SELECT user_id, unnest(generate_series(min(bucket), max(bucket), INTERVAL '6 hours')) AS bucket FROM b GROUP BY 1) SELECT s.bucket, s.user_id, top FROM s LEFT JOIN b ON s.user_id IS NOT DISTINCT FROM b.user_id AND s.bucket = b.bucket")
simple("sliding_window", "events", lambda e: e.groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"), F.max("value").alias("top")).select(F.col("window.start").alias("bucket"), "n", "top"), "SELECT bucket, count(*) AS n, max(value) AS top FROM (SELECT value, unnest([h, h - INTERVAL 1 HOUR]) AS bucket FROM (SELECT value, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS h FROM events)) GROUP BY 1")
simple("session_window", "events", lambda e: e.groupBy(F.session_window("ts", "2 hours"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n"), "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
simple("downsample", "events", lambda e: tables.downsample(e, "ts", "1d", ["event_type"], "value", "max"), "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS ts, event_type, max(value) AS value FROM events GROUP BY 1, 2")

# Series
WIN = "(PARTITION BY user_id ORDER BY ts, event_id)"
NULLS = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events)"


def per_user(column):
    def build(e):
        w = S.window_of(BY_USER, "ts", "event_id")
        e = e.withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))
        return e.select("event_id", column(w))

    return build


def frame_sql(expr: str, k: int) -> str:
    return f"{expr} OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


simple("series_delta", "events", per_user(lambda w: r(S.delta(F.col("value"), w)).alias("delta")), f"SELECT event_id, round(coalesce(value - lag(value) OVER {WIN}, 0), 4) AS delta FROM events")
simple("series_rate", "events", per_user(lambda w: r(S.rate(F.col("value"), F.col("ts"), w), 6).alias("rate")), f"SELECT event_id, round(CASE WHEN d > 0 THEN x / (d / 1e6) ELSE 0 END, 6) AS rate FROM (SELECT event_id, value - lag(value) OVER {WIN} AS x, epoch_us(ts) - lag(epoch_us(ts)) OVER {WIN} AS d FROM events)")
simple("series_moving_avg", "events", per_user(lambda w: r(S.moving_avg(F.col("value"), w, 7)).alias("avg")), f"SELECT event_id, round({frame_sql('avg(value)', 7)}, 4) AS avg FROM events")
simple("series_moving_stddev", "events", per_user(lambda w: r(S.moving_stddev(F.col("value"), w, 7)).alias("sd")), f"SELECT event_id, round(coalesce({frame_sql('stddev_samp(value)', 7)}, 0), 4) AS sd FROM events")
simple("series_forward_fill", "events", per_user(lambda w: S.forward_fill(F.col("v"), w).alias("v")), f"SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER {WIN}, 0) AS v FROM {NULLS}")
simple("series_interpolate", "events", per_user(lambda w: r(S.interpolate(F.col("v"), w)).alias("v")), f"""WITH n AS (SELECT *, row_number() OVER {WIN} AS n, CASE WHEN v IS NOT NULL THEN row_number() OVER {WIN} END AS k FROM {NULLS}),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS a, last_value(k IGNORE NULLS) OVER b AS i, first_value(v IGNORE NULLS) OVER f AS z, first_value(k IGNORE NULLS) OVER f AS j FROM n
 WINDOW b AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, a + (n - i - 1) / (CASE WHEN j - i > 1 THEN j - i - 1 ELSE 1 END)::DOUBLE * (z - a), a, z, 0), 4) AS v FROM f""")
simple("series_rolling_zscore", "events", per_user(lambda w: r(S.zscore(F.col("value"), S.moving_avg(F.col("value"), w, 9), S.moving_stddev(F.col("value"), w, 9))).alias("z")), f"SELECT event_id, round(CASE WHEN s < 1e-10 THEN 0 ELSE (value - m) / s END, 4) AS z FROM (SELECT event_id, value, {frame_sql('avg(value)', 9)} AS m, coalesce({frame_sql('stddev_samp(value)', 9)}, 0) AS s FROM events)")
simple("series_anomaly_score", "events", per_user(lambda w: r(S.anomaly_score(F.col("value"), w, BY_USER, 9, 1.5)).alias("score")), f"SELECT event_id, round(CASE WHEN n >= 9 AND s >= 1e-10 AND abs((value - m) / s) > 1.5 THEN abs((value - m) / s) ELSE 0 END, 4) AS score FROM (SELECT event_id, value, row_number() OVER {WIN} AS n, {frame_sql('avg(value)', 9)} AS m, coalesce({frame_sql('stddev_samp(value)', 9)}, 0) AS s FROM events)")
simple("series_ema", "events", lambda e: S.ema(e.select("event_id", "user_id", "ts", "value"), BY_USER, ["ts", "event_id"], "value", 0.3).select("event_id", r("ema").alias("ema")), "SELECT event_id, round(ema, 4) AS ema FROM (SELECT unnest(ids) AS event_id, unnest(list_transform(range(1, len(v) + 1), lambda n: list_reduce(v[1:n], lambda l, x: 0.3 * x + 0.7 * l))) AS ema FROM (SELECT list(event_id ORDER BY ts, event_id) AS ids, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id))")

# Anomalies
SMOOTHING_SQL = f"""WITH s AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1),
e AS (SELECT user_id, unnest(ids) AS event_id, unnest(v) AS value, unnest(list_transform(range(1, len(v) + 1), lambda n: CASE WHEN n > 1 THEN list_reduce(v[1:n - 1], lambda l, x: 0.3 * x + 0.7 * l) END)) AS level FROM s),
x AS (SELECT *, abs(value - coalesce(level, value)) AS score FROM e),
d AS (SELECT user_id, coalesce(stddev_samp(score), 0) AS sd FROM x GROUP BY 1)
SELECT event_id, round(score, 3) AS score, score > 3 * sd AND sd > 0 AS is_anomaly FROM x JOIN d USING (user_id)"""
simple("anomaly_zscore", "events", lambda e: anomaly.zscore(e, BY_USER, "value", 2.5).select("event_id", r("score").alias("score"), "is_anomaly"), "SELECT event_id, round(abs(value - m) / s, 4) AS score, abs(value - m) / s > 2.5 AS is_anomaly FROM events JOIN (SELECT user_id, avg(value) AS m, CASE WHEN coalesce(stddev_samp(value), 0) < 1e-10 THEN 1 ELSE stddev_samp(value) END AS s FROM events GROUP BY 1) USING (user_id)")
IQR_STATS = f"(SELECT user_id, {rank_sql(25)} AS q1, {rank_sql(75)} AS q3 FROM events GROUP BY 1)"
simple("anomaly_iqr", "events", lambda e: anomaly.iqr(e, BY_USER, "value").select("event_id", r("score").alias("score"), "is_anomaly"), f"SELECT event_id, round(x, 4) AS score, x > 0 AS is_anomaly FROM (SELECT event_id, greatest(q1 - 1.5 * (q3 - q1) - value, value - (q3 + 1.5 * (q3 - q1)), 0) AS x FROM events JOIN {IQR_STATS} USING (user_id))")
simple("anomaly_ensemble", "events", lambda e: anomaly.ensemble(e, BY_USER, "value").select("event_id", r("score").alias("score"), "is_anomaly"), f"SELECT event_id, round(x, 4) AS score, x > 2.25 AS is_anomaly FROM (SELECT event_id, (abs(value - m) / s + greatest(q1 - 1.5 * (q3 - q1) - value, value - (q3 + 1.5 * (q3 - q1)), 0)) / 2 AS x FROM events JOIN {IQR_STATS} USING (user_id) JOIN (SELECT user_id, avg(value) AS m, CASE WHEN coalesce(stddev_samp(value), 0) < 1e-10 THEN 1 ELSE stddev_samp(value) END AS s FROM events GROUP BY 1) USING (user_id))")
query("anomaly_smoothing", SMOOTHING_SQL)(lambda spark, d: anomaly.smoothing_residuals(events(spark, d).select("event_id", "user_id", "ts", "value"), BY_USER, ["ts", "event_id"], "value").select("event_id", r("score", 3).alias("score"), "is_anomaly"))
simple("anomaly_detect_all", "events", lambda e: anomaly.detect(e, BY_USER, "ts", "value").select("user_id", "ts", "value", r("score").alias("score"), "is_anomaly", "threshold", "model"), f"WITH s AS (SELECT user_id, ts, value, abs(value - m) / s AS z, greatest(q1 - 1.5 * (q3 - q1) - value, value - (q3 + 1.5 * (q3 - q1)), 0) AS x FROM events JOIN {IQR_STATS} USING (user_id) JOIN (SELECT user_id, avg(value) AS m, CASE WHEN coalesce(stddev_samp(value), 0) < 1e-10 THEN 1 ELSE stddev_samp(value) END AS s FROM events GROUP BY 1) USING (user_id)) SELECT user_id, ts, value, round(z, 4) AS score, z > 3 AS is_anomaly, 3.0::DOUBLE AS threshold, 'zscore' AS model FROM s UNION ALL SELECT user_id, ts, value, round(x, 4), x > 0, 1.5::DOUBLE, 'iqr' FROM s")
query("anomaly_isolation_forest")(lambda spark, d: anomaly.isolation_forest(events(spark, d).select("event_id", "value"), "value").select("event_id", r("score").alias("score"), "is_anomaly"))

# Forecasts
LISTS = "(SELECT user_id, list(value ORDER BY ts) AS v FROM events GROUP BY 1)"


def rounded(df: DataFrame, n: int = 4) -> DataFrame:
    return df.select("user_id", "step", *[r(c, n).alias(c) for c in ("prediction", "lower", "upper")])


def bounds(p: str, se: str, widening: str = "0.1", h: int = 3, src: str = LISTS, n: int = 4) -> str:
    return f"SELECT user_id, step, round(p, {n}) AS prediction, round(p - 1.96 * se * sqrt(1 + {widening} * (step - 1)), {n}) AS lower, round(p + 1.96 * se * sqrt(1 + {widening} * (step - 1)), {n}) AS upper FROM (SELECT user_id, step, {p} AS p, {se} AS se FROM {src}, (SELECT unnest(range(1, {h + 1}))::INT AS step))"


simple("forecast_ses", "events", lambda e: rounded(forecast.ses(e, BY_USER, "ts", "value")), bounds("list_reduce(v, lambda l, x: 0.3 * x + 0.7 * l)", "0.0"))
simple("forecast_naive", "events", lambda e: rounded(forecast.naive(e, BY_USER, "ts", "value")), bounds("v[-1]", "coalesce(list_sum(list_transform(range(2, len(v) + 1), lambda i: abs(v[i] - v[i - 1]))), 0) / len(v)"))
simple("forecast_drift", "events", lambda e: rounded(forecast.drift(e, BY_USER, "ts", "value"), 9), bounds("v[-1] + step * (CASE WHEN len(v) > 1 THEN (v[-1] - v[1]) / (len(v) - 1) ELSE 0 END)", "0.0", n=9))
simple("forecast_moving_average", "events", lambda e: rounded(forecast.moving_average(e, BY_USER, "ts", "value")), bounds("(v[-3] * 1 + v[-2] * 2 + v[-1] * 3) / 6.0", "0.1", "0.05", src=f"(SELECT * FROM {LISTS} WHERE len(v) >= 3)"))
HOLT_SQL = """WITH RECURSIVE v AS (SELECT user_id, list(value ORDER BY ts) AS v FROM events GROUP BY 1 HAVING count(*) >= 3),
f(user_id, i, l, b) AS (SELECT user_id, 1, v[1], (v[3] - v[1]) / 2 FROM v
  UNION ALL SELECT user_id, i + 1, nl, 0.3 * (nl - l) + 0.7 * b FROM (SELECT f.user_id, i, l, b, 0.5 * v[i + 1] + 0.5 * (l + b) AS nl FROM f JOIN v USING (user_id) WHERE i < len(v))),
e AS (SELECT user_id, arg_max(l, i) AS l, arg_max(b, i) AS b FROM f GROUP BY 1)
SELECT user_id, step, round(l + step * b, 4) AS prediction, round(l + step * b - 0.196 * sqrt(1 + 0.1 * (step - 1)), 4) AS lower, round(l + step * b + 0.196 * sqrt(1 + 0.1 * (step - 1)), 4) AS upper FROM e, (SELECT unnest(range(1, 4))::INT AS step)"""
HOLT_WINTERS_SQL = """WITH RECURSIVE v AS (SELECT user_id, list(value ORDER BY ts) AS v FROM events GROUP BY 1 HAVING count(*) >= 8),
f(user_id, i, l, b, s) AS (SELECT user_id, 1, list_avg(v[1:4]), (v[5] - v[1]) / 4, list_transform([1, 2, 3, 4], lambda k: list_sum(list_transform(range(k, len(v) + 1, 4), lambda j: v[j])) / (len(v) // 4) - list_avg(v)) FROM v
  UNION ALL SELECT user_id, i + 1, nl, 0.1 * (nl - l) + 0.9 * b, list_transform([1, 2, 3, 4], lambda k: CASE WHEN k = i % 4 + 1 THEN 0.2 * (x - nl) + 0.8 * s[k] ELSE s[k] END)
  FROM (SELECT f.user_id, i, l, b, s, v[i + 1] AS x, 0.3 * (v[i + 1] - s[i % 4 + 1]) + 0.7 * (l + b) AS nl FROM f JOIN v USING (user_id) WHERE i < len(v))),
e AS (SELECT user_id, arg_max(l, i) AS l, arg_max(b, i) AS b, arg_max(s, i) AS s FROM f GROUP BY 1)
SELECT user_id, step, round(p, 4) AS prediction, round(p - 0.196 * sqrt(1 + 0.1 * (step - 1)), 4) AS lower, round(p + 0.196 * sqrt(1 + 0.1 * (step - 1)), 4) AS upper
FROM (SELECT user_id, step, l + step * b + s[(3 + step) % 4 + 1] AS p FROM e, (SELECT unnest(range(1, 5))::INT AS step))"""
query("forecast_holt", HOLT_SQL)(lambda spark, d: rounded(forecast.holt(events(spark, d), BY_USER, "ts", "value")))
simple("forecast_long_form", "events", lambda e: forecast.forecast(e, BY_USER, "ts", "value", "naive", 2, 0.9).select("user_id", "step", r("prediction").alias("prediction"), r("lower").alias("lower"), r("upper").alias("upper"), "confidence", "model"), f"SELECT user_id, step, round(p, 4) AS prediction, round(p - 1.645 * se * sqrt(1 + 0.1 * (step - 1)), 4) AS lower, round(p + 1.645 * se * sqrt(1 + 0.1 * (step - 1)), 4) AS upper, 0.9::DOUBLE AS confidence, 'naive' AS model FROM (SELECT user_id, step, v[-1] AS p, coalesce(list_sum(list_transform(range(2, len(v) + 1), lambda i: abs(v[i] - v[i - 1]))), 0) / len(v) AS se FROM {LISTS}, (SELECT unnest(range(1, 3))::INT AS step))")
query("forecast_holt_winters", HOLT_WINTERS_SQL)(lambda spark, d: rounded(forecast.holt_winters(events(spark, d).select("user_id", "ts", "value"), BY_USER, "ts", "value")))

# Features
simple("feat_statistical", "events", lambda e: features.statistical(e, BY_USER, "value").select("user_id", *[r(c, 3).alias(c) for c in ("mean", "median", "std", "min", "max", "range", "q1", "q3", "iqr", "skewness", "kurtosis", "entropy", "cv")], r("var", 2).alias("var"), r("energy", 2).alias("energy")), f"""WITH s AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n, sum(abs(value)) AS t, {rank_sql(50)} AS median, {rank_sql(25)} AS q1, {rank_sql(75)} AS q3 FROM events GROUP BY 1)
SELECT user_id, round(any_value(m), 3) AS mean, round(any_value(median), 3) AS median, round(any_value(sd), 3) AS std, round(min(value), 3) AS min, round(max(value), 3) AS max, round(max(value) - min(value), 3) AS range, round(any_value(q1), 3) AS q1, round(any_value(q3), 3) AS q3, round(any_value(q3 - q1), 3) AS iqr,
round(avg(pow(value - m, 3)) / pow(any_value(sd), 3), 3) AS skewness, round(avg(pow(value - m, 4)) / pow(any_value(sd), 4) - 3, 3) AS kurtosis, round(-sum(CASE WHEN abs(value) > 0 THEN abs(value) / t * log2(abs(value) / t) ELSE 0 END), 3) AS entropy, round(any_value(sd / abs(m)), 3) AS cv, round(var_samp(value), 2) AS var, round(sum(value * value), 2) AS energy FROM events JOIN s USING (user_id) GROUP BY 1""")
simple("feat_temporal", "events", lambda e: features.temporal(e, BY_USER, ["ts", "event_id"], "value").select("user_id", "zero_crossings", "mean_crossings", "peaks", "troughs", "change_points", r("autocorrelation").alias("autocorrelation"), r("stationarity").alias("stationarity")), f"""WITH x AS (SELECT user_id, value AS v, lag(value) OVER {WIN} AS p, lag(value, 2) OVER {WIN} AS pp, lead(value) OVER {WIN} AS nx, avg(value) OVER (PARTITION BY user_id) AS m, var_pop(value) OVER (PARTITION BY user_id) AS vp, row_number() OVER {WIN} AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, count(*) FILTER (v * p < 0) AS zero_crossings, count(*) FILTER ((v - m) * (p - m) < 0) AS mean_crossings, count(*) FILTER (v > p AND v > nx) AS peaks, count(*) FILTER (v < p AND v < nx) AS troughs, count(*) FILTER ((v - p) * (p - pp) < 0 AND abs(v - p) > 2.0 * (sqrt(vp * n) / n)) AS change_points,
round(sum((v - m) * (p - m)) / sum((v - m) * (v - m)), 4) AS autocorrelation, round(least(var_pop(v) FILTER (i <= floor(n / 2)), var_pop(v) FILTER (i > floor(n / 2))) / greatest(var_pop(v) FILTER (i <= floor(n / 2)), var_pop(v) FILTER (i > floor(n / 2))), 4) AS stationarity FROM x GROUP BY 1""")
simple("feat_trend", "events", lambda e: features.trend(e, BY_USER, ["ts", "event_id"], "value").select("user_id", r("slope").alias("slope"), r("intercept").alias("intercept"), r("residual_var", 2).alias("residual_var"), "direction"), f"SELECT user_id, round(s, 4) AS slope, round(c, 4) AS intercept, round(ss / n, 2) AS residual_var, CASE WHEN s > 0.01 THEN 1 WHEN s < -0.01 THEN -1 ELSE 0 END AS direction FROM (SELECT user_id, regr_slope(value, i) AS s, regr_intercept(value, i) AS c, regr_syy(value, i) - pow(regr_sxy(value, i), 2) / regr_sxx(value, i) AS ss, count(*) AS n FROM (SELECT user_id, value, (row_number() OVER {WIN} - 1)::DOUBLE AS i FROM events) GROUP BY 1)")
SPECTRAL_SQL = """WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events),
m AS (SELECT user_id, k, any_value(n) AS n, sqrt(pow(sum(value * cos(2 * pi() * ((k * t) % n) / n)), 2) + pow(sum(value * sin(2 * pi() * ((k * t) % n) / n)), 2)) AS mag FROM (SELECT *, unnest(range(0, n // 2)) AS k FROM s) GROUP BY 1, 2),
c AS (SELECT *, k / n AS f, mag * mag AS e, sum(mag * mag) OVER (PARTITION BY user_id ORDER BY k) AS upto, sum(mag * mag) OVER (PARTITION BY user_id) AS total, sum(mag) OVER (PARTITION BY user_id) AS mags FROM m)
SELECT user_id, round(arg_max(f, mag), 4) AS dominant, round(sum(f * e) / any_value(total), 4) AS centroid, round(min(f) FILTER (upto >= 0.85 * total), 4) AS rolloff, round(-sum(CASE WHEN mag > 0 THEN mag / mags * log2(mag / mags) ELSE 0 END), 4) AS entropy, round(any_value(total), 1) AS energy FROM c GROUP BY 1"""
query("feat_vector")(lambda spark, d: features.vector(events(spark, d).select("user_id", "ts", "event_id", "value"), BY_USER, ["ts", "event_id"], "value").select("user_id", F.transform("features", lambda x: F.round(x, 3)).alias("features")))
query("feat_spectral", SPECTRAL_SQL)(lambda spark, d: features.spectral(events(spark, d).select("user_id", "ts", "value"), BY_USER, ["ts"], "value").select("user_id", *[r(c).alias(c) for c in ("dominant", "centroid", "rolloff", "entropy")], r("energy", 1).alias("energy")))

# Storage
simple("retention_expired", "events", lambda e: tables.expired(e, "ts", NOW, "14d").select("event_id", "ts"), f"SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 14 DAY")
simple("retention_kept", "events", lambda e: tables.retained(e, "ts", NOW, "14d").select("event_id", "ts"), f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY")
simple("tier_assign", "events", lambda e: tables.tiered(e, "ts", NOW).select("event_id", "tier"), f"SELECT event_id, CASE WHEN TIMESTAMP '{NOW}' - ts <= INTERVAL 7 DAY THEN 'hot' WHEN TIMESTAMP '{NOW}' - ts <= INTERVAL 30 DAY THEN 'warm' WHEN TIMESTAMP '{NOW}' - ts <= INTERVAL 365 DAY THEN 'cold' ELSE 'frozen' END AS tier FROM events")


def scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{spark.sparkContext.getConf().get('spark.checkpoint.dir') or tempfile.mkdtemp(prefix='chronolith-')}/{name}-{uuid.uuid4().hex}"


@query("partition_prune", "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 06:30:00' AND ts < TIMESTAMP '2024-01-08 12:00:00'")
def partition_prune(spark, d):
    from datetime import datetime

    path = scratch(spark, "events")
    tables.write(events(spark, d), path, "ts", "day")
    return tables.read_range(spark, path, "ts", datetime(2024, 1, 5, 6, 30), datetime(2024, 1, 8, 12), "day").select("event_id", "ts", "value")


@query("table_life_cycle", "SELECT count(*) AS rows, count(DISTINCT date_trunc('day', ts)) AS partitions FROM events WHERE ts >= TIMESTAMP '2024-01-11' AND event_type <> 'click'")
def table_life_cycle(spark, d):
    from datetime import datetime

    path, to = scratch(spark, "table"), scratch(spark, "table-deleted")
    tables.create(spark, path, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double", "ts", ("user_id", "event_type"), "day", "20d")
    tables.insert(spark, path, events(spark, d))
    tables.drop_expired(spark, path, datetime(2024, 1, 31), tables.describe(spark, path)["keep"], "day")
    tables.delete(spark, path, to, "event_type = 'click'")
    return tables.table_stats(spark, to).select("rows", "partitions")


@query("downsample_table", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS ts, event_type, list_sort(list(value))[1 + cast(floor(0.95 * (count(value) - 1) + 0.5) AS INT)] AS value FROM events GROUP BY 1, 2")
def downsample_table(spark, d):
    path = scratch(spark, "table")
    tables.write(events(spark, d), path, "ts", "day")
    to = tables.downsample_table(spark, path, "ts", ["event_type"], "value", tables.DownsampleRule("6h", "6h", "p95"))
    return tables.read(spark, to).select("ts", "event_type", "value")


@query("csv_round_trip", "SELECT event_id, ts, user_id, event_type, value FROM events")
def csv_round_trip(spark, d):
    path, rows = scratch(spark, "csv"), events(spark, d).select("event_id", "ts", "user_id", "event_type", "value")
    tables.export_csv(rows, path)
    return tables.import_csv(spark, path, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")


# Messages and routing
simple("route_time", "events", lambda e: e.select("event_id", messages.route_time(F.col("ts"), 7).alias("part")), "SELECT event_id, (hour(ts) % 7)::INT AS part FROM events")
simple("route_hash", "events", lambda e: e.select("event_id", messages.route_hash(F.concat(F.col("event_type"), F.lit("-"), F.col("user_id").cast("string")), 5).alias("part")), "SELECT event_id, (list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(event_type || '-' || user_id::VARCHAR, ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: (h * 33 + b) % 18446744073709551616::HUGEINT) % 5)::INT AS part FROM events")
simple("codec_json", "events", lambda e: e.select("event_id", messages.from_json(messages.to_json("user_id", "event_type", "value"), "user_id long, event_type string, value double").alias("m")).select("event_id", "m.user_id", "m.event_type", "m.value"), "SELECT event_id, user_id, event_type, value FROM events")
simple("codec_csv", "events", lambda e: e.select("event_id", messages.from_csv(messages.to_csv("user_id", "event_type", "value"), "user_id long, event_type string, value double").alias("m")).select("event_id", "m.user_id", "m.event_type", "m.value"), "SELECT event_id, user_id, event_type, value FROM events")
simple("encode_json", "events", lambda e: e.select("event_id", messages.to_json("user_id", "event_type").alias("body")), "SELECT event_id, '{\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}' AS body FROM events")
simple("encode_csv", "events", lambda e: e.select("event_id", messages.to_csv("user_id", "event_type", sep=";").alias("body")), "SELECT event_id, user_id || ';' || event_type AS body FROM events")
simple("route_range", "events", lambda e: e.select("event_id", messages.route("range", 3, F.when(F.col("event_id") % 7 != 0, F.col("event_type"))).alias("part")), "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE (list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(event_type, ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: (h * 33 + b) % 18446744073709551616::HUGEINT) % 3)::INT END AS part FROM events")
simple("props_json", "events", lambda e: e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")

# SQL: durations are intervals and buckets are window(); the text runs on Spark's own parser.
SQL_TEXTS = {
    "sql_basic": ("SELECT event_id, ts, value FROM events WHERE event_type = 'click' AND ts > timestamp_ntz '2024-01-31 00:00:00' - INTERVAL 10 DAYS ORDER BY ts DESC LIMIT 50", "SELECT event_id, ts, value FROM events WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-31' - INTERVAL 10 DAY ORDER BY ts DESC LIMIT 50"),
    "sql_agg": ("SELECT event_type, round(avg(value), 4) AS mean, max(value) AS top, count(*) AS n FROM events GROUP BY event_type", "SELECT event_type, round(avg(value), 4) AS mean, max(value) AS top, count(*) AS n FROM events GROUP BY event_type"),
    "sql_bucket": ("SELECT window.start AS bucket, event_type, round(avg(value), 4) AS mean FROM events WHERE value BETWEEN 5 AND 200 GROUP BY window(ts, '1 hour'), event_type", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS bucket, event_type, round(avg(value), 4) AS mean FROM events WHERE value BETWEEN 5 AND 200 GROUP BY 1, 2"),
}
for _name, (_text, _sql) in SQL_TEXTS.items():
    query(_name, _sql)(lambda spark, d, t=_text: spark.sql(t.replace("FROM events", "FROM {events}"), events=events(spark, d)))


# Streams: what is in the files is worked off once; windows still open at the end are not given out.
def once(spark, d, build, again: str = "") -> DataFrame:
    src = scratch(spark, "stream-in")
    events(spark, d).write.parquet(src)
    if again:
        events(spark, d).where(again).write.mode("append").parquet(src)
    return windows.run_once(build(windows.stream(spark, src)), scratch(spark, "stream-out"), scratch(spark, "stream-state"))


@query("stream_tumbling", "SELECT bucket, n, top FROM (SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n, max(value) AS top FROM events GROUP BY 1) WHERE bucket + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_tumbling(spark, d):
    out = once(spark, d, lambda s: windows.tumbling(s, "ts", "1h", [], n=F.count("*"), top=F.max("value")))
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("stream_session", "SELECT * FROM (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s) WHERE \"end\" <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_session(spark, d):
    out = once(spark, d, lambda s: windows.sessions(s, "ts", "2h", "user_id"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("stream_dedup", "SELECT event_id, user_id FROM events")
def stream_dedup(spark, d):
    # Every third event comes twice, in another file.
    return once(spark, d, lambda s: windows.deduplicated(s, "ts", ["event_id"]).select("event_id", "user_id"), again="event_id % 3 = 0")


@query("stream_stateful_ema", "SELECT user_id, count(*) AS n, round(list_reduce(list(value ORDER BY ts), lambda l, x: 0.3 * x + 0.7 * l), 4) AS ema FROM events GROUP BY 1")
def stream_stateful_ema(spark, d):
    out = once(spark, d, lambda s: windows.stateful_ema(s.select("user_id", "ts", "value"), "user_id", "ts", "value", 0.3))
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("ema", "n"), 4).alias("ema"))


# Classifiers
def classified(model: str):
    def run(spark, d):
        rows = read(spark, d, "embeddings").where("embedding is not null").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"))
        fitted = classify.train(rows, ["vector"], "label", model)
        return classify.predict(fitted, rows, ["vec_id", "label"])

    return run


for _model in classify.MODELS:
    query(f"classify_{_model}")(classified(_model))
