"""Known results of small inputs, and the inputs at the edges."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.functions import aggregates as A
from chronolith.functions import durations
from chronolith.functions import series as S
from chronolith.operators import anomaly, classify, features, forecast, registry
from chronolith.plans.builder import Query
from chronolith.sources import messages, tables
from chronolith.streaming import windows

T0 = datetime(2024, 1, 1)
SHAPE = "k string, i int, ts timestamp_ntz, v double"
SPIKE = [1.0, 2.0, 3.0, 100.0, 4.0, 5.0]
STEPS = [10.0, 12.0, 11.0, 15.0, 15.0]


def series(spark, values, key="a", seconds=None):
    at = seconds or range(len(values))
    return spark.createDataFrame([(key, i, T0 + timedelta(seconds=s), v) for i, (s, v) in enumerate(zip(at, values, strict=True))], SHAPE)


def column(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def close(got, want, tol=1e-6):
    return np.allclose(np.array(got, dtype=float), np.array(want, dtype=float), atol=tol, rtol=0)


def test_detectors(spark):
    df = series(spark, SPIKE)
    assert close(column(anomaly.zscore(df, ["k"], "v"), "score"), [0.458461, 0.433225, 0.407988, 2.039941, 0.382752, 0.357515])
    assert not any(column(anomaly.zscore(df, ["k"], "v"), "is_anomaly"))
    assert close(column(anomaly.iqr(df, ["k"], "v"), "score"), [0, 0, 0, 90.5, 0, 0])
    out = anomaly.ensemble(df, ["k"], "v")
    assert close(column(out, "score"), [0.22923, 0.216612, 0.203994, 46.269971, 0.191376, 0.178758])
    assert column(out, "is_anomaly") == [False, False, False, True, False, False]
    long = anomaly.detect(df, ["k"], "ts", "v", forest=(10, 256))
    assert {(r.model, r.threshold) for r in long.where("model <> 'isolation_forest'").collect()} == {("zscore", 3.0), ("iqr", 1.5)}
    assert long.count() == 18
    forest = {r.ts.second: r for r in long.where("model = 'isolation_forest'").collect()}
    scores = [forest[i].score for i in range(6)]
    assert max(scores) == scores[3] and forest[3].threshold == pytest.approx(np.mean(scores) + 2 * np.std(scores))


def test_path_norm():
    assert [round(anomaly.path_norm(n), 5) for n in (1, 8, 256)] == [1.0, 2.14182, 9.09034]


def test_null_keys_stay(spark):
    df = series(spark, SPIKE).unionByName(series(spark, SPIKE, None))
    for f in (anomaly.zscore, anomaly.iqr, anomaly.ensemble):
        got = f(df, ["k"], "v")
        assert got.count() == 12
        assert close(column(got.where("k is null"), "score"), column(got.where("k = 'a'"), "score"))
    assert anomaly.detect(df, ["k"], "ts", "v").count() == 24
    assert A.grouped(df, ["k"], {"n": F.count("*")}, {"p": ("v", 50)}).where("k is null").first()[1:] == (6, 4.0)
    assert features.vector(df, ["k"], ["i"], "v").count() == 2


def test_series(spark):
    df = series(spark, STEPS, seconds=[0, 1, 3, 3, 5])
    w = S.window_of(["k"], "i")
    assert close(column(df.withColumn("x", S.rate(F.col("v"), F.col("ts"), w)), "x"), [0, 2, -0.5, 0, 0])
    assert close(column(df.withColumn("x", S.delta(F.col("v"), w)), "x"), [0, 2, -1, 4, 0])
    assert close(column(df.withColumn("x", S.moving_avg(F.col("v"), w, 3)), "x"), [10, 11, 11, 12.666667, 13.666667])
    assert close(column(df.withColumn("x", S.moving_stddev(F.col("v"), w, 3)), "x"), [0, 1.414214, 1, 2.081666, 2.309401])
    assert close(column(S.ema(df, ["k"], ["i"], "v", 0.5), "ema"), [10, 11, 11, 13, 14])
    gaps = series(spark, [None, 1.0, None, None, 4.0, None])
    assert close(column(gaps.withColumn("x", S.forward_fill(F.col("v"), w)), "x"), [0, 1, 1, 1, 4, 4])
    assert close(column(gaps.withColumn("x", S.interpolate(F.col("v"), w)), "x"), [1, 1, 1, 2.5, 4, 4])
    assert column(S.ema(gaps, ["k"], ["i"], "v", 0.5), "ema") == [None, 1.0, 1.0, 1.0, 2.5, 2.5]
    flat = series(spark, [1.0, 1.0, 2.0, 1.0, 9.0])
    assert close(column(flat.withColumn("x", S.anomaly_score(F.col("v"), w, ["k"], 3, 1.0)), "x"), [0, 0, 1.154701, 0, 1.147079])
    assert df.groupBy("k").agg(A.trend(F.col("v"), F.col("i"), 0.5)).first()[1] == 1
    slope, intercept = A.linear_regression(F.col("v"), F.col("i").cast("double"))
    assert close(df.groupBy("k").agg(slope, intercept).first()[1:], [1.3, 10.0])


def test_percentiles(spark, monkeypatch):
    df = series(spark, [1.0, 2.0, 3.0, 4.0])
    ranks = {f"p{n}": ("v", p) for n, p in enumerate((0, 25, 50, 75, 95, 100, -5, 150))}
    assert A.grouped(df, ["k"], {}, ranks).first()[1:] == (1, 2, 3, 3, 4, 4, 1, 4)
    nulls = series(spark, [None, None], "b").unionByName(df)
    got = {r.k: tuple(r)[1:] for r in A.grouped(nulls, ["k"], {"n": F.count("*")}, {"p": ("v", 50)}).collect()}
    assert got == {"a": (4, 3.0), "b": (2, None)}
    assert A.grouped(df.where("false"), ["k"], {}, ranks).count() == 0
    # Between sketched bounds: groups larger than SMALL, with many ties and without.
    rng = np.random.default_rng(1)
    sizes = {"few": 3, "ties": 60_000, "many": 45_001, "one": 12_000}
    values = {"few": [3.0, 1.0, 2.0], "ties": rng.integers(0, 9, 60_000).astype(float), "many": rng.normal(0, 1, 45_001), "one": np.ones(12_000)}
    rows = spark.createDataFrame([(k, float(x)) for k in sizes for x in values[k]], "k string, v double").repartition(7)
    ps = (0, 0.01, 25, 50, 95, 99.9, 100)
    assert A.SMALL == 10_000
    got = {r.k: tuple(r)[1:] for r in A.grouped(rows, ["k"], {}, {f"p{i}": ("v", p) for i, p in enumerate(ps)}).collect()}
    for k, x in values.items():
        x = np.sort(x)
        assert got[k] == tuple(x[math.floor(p / 100 * (len(x) - 1) + 0.5)] for p in ps), k


def test_no_array_of_a_group(spark, sf):
    from chronolith.plans import catalogue

    for name in ("agg_percentiles", "agg_median_nearest", "anomaly_iqr", "anomaly_ensemble", "feat_statistical", "bucket_multi_agg_by_tag", "forecast_naive", "forecast_drift", "forecast_moving_average"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan, name


def test_builder_takes_percentiles_and_buckets(spark):
    df = series(spark, STEPS, seconds=[0, 1, 60, 61, 62])
    got = Query(df, "ts").group_by("k", every="1m").aggregate("p50", "v", "mid").aggregate("avg", "v", "mean").build().orderBy("bucket").collect()
    assert [(r.mid, r.mean) for r in got] == [(12.0, 11.0), (15.0, pytest.approx(41 / 3))]
    with pytest.raises(ValueError):
        Query(df, "ts").aggregate("nonsense", "v", "x").build()
    names = {r.name for r in A.list_functions(spark).collect()}
    assert {"mean", "avg", "p95", "rate", "holt_winters", "interpolate", "fill"} <= names


def test_forecasts(spark):
    def run(values, model, h, **options):
        out = forecast.forecast(series(spark, values), ["k"], "ts", "v", model, h, **options).orderBy("step")
        return [tuple(r) for r in out.select("prediction", "lower", "upper").collect()]

    assert close(run([float(x) for x in range(1, 11)], "ses", 5), [[7.760825] * 3] * 5)
    level, trend = 11.386998, 2.099241
    assert close([r[0] for r in run([1.0, 3.0, 4.0, 8.0, 9.0, 12.0], "holt", 2)], [level + trend, level + 2 * trend], 2e-6)
    season = [10.0, 20.0, 30.0, 40.0, 12.0, 22.0, 32.0, 42.0]
    got = run(season, "holt_winters", 4)
    assert close([r[0] for r in got], [13.125443, 23.399926, 33.720124, 44.076496]) and close(got[0][1], 12.929443)
    # A season that has only begun adds to its sum but not to the count.
    begun, m = [*season, 14.0], 4
    s = [sum(begun[i::m]) / (len(begun) // m) - sum(begun) / len(begun) for i in range(m)]
    lv, b = sum(begun[:m]) / m, (begun[m] - begun[0]) / m
    for i in range(1, len(begun)):
        new = 0.3 * (begun[i] - s[i % m]) + 0.7 * (lv + b)
        b = 0.1 * (new - lv) + 0.9 * b
        s[i % m] = 0.2 * (begun[i] - new) + 0.8 * s[i % m]
        lv = new
    assert close([r[0] for r in run(begun, "holt_winters", 4)], [lv + k * b + s[(m - 1 + k) % m] for k in range(1, 5)])
    assert close(run([1.0, 3.0, 2.0, 5.0], "naive", 3), [(5, 2.06, 7.94), (5, 1.916502, 8.083498), (5, 1.779391, 8.220609)])
    assert close([r[0] for r in run([3.0, 2.0, 5.0], "moving_average", 1)], [3.666667])
    assert close([r[0] for r in run([1.0, 3.0, 2.0, 7.0], "drift", 2)], [9, 11])
    assert run([1.0], "holt", 2) == [] and run([1.0], "moving_average", 2) == [] and close(run([4.0], "naive", 1), [[4, 4, 4]]) and close(run([4.0], "drift", 1), [[4, 4, 4]])
    with pytest.raises(ValueError):
        forecast.forecast(series(spark, [1.0]), ["k"], "ts", "v", "arima")


def test_features(spark):
    df = series(spark, SPIKE)
    st, te = features.statistical(df, ["k"], "v").first(), features.temporal(df, ["k"], ["i"], "v").first()
    assert close([st.std, st.entropy, st.skewness, st.kurtosis], [39.625329, 0.838967, 1.356929, -0.089696])
    assert close([te.autocorrelation, te.stationarity], [-0.220171, 0.000329])
    assert (te.peaks, te.troughs, te.mean_crossings, te.change_points) == (1, 1, 2, 1)
    wave = [math.sin(2 * math.pi * 2 * i / 16) for i in range(16)]
    sp = features.spectral(series(spark, wave), ["k"], ["i"], "v").first()
    assert close([sp.dominant, sp.centroid, sp.energy], [0.125, 0.125, 64])
    vec = features.vector(df, ["k"], ["i"], "v").first().features
    mags = np.abs(np.fft.rfft(SPIKE))[:3]
    p = mags / mags.sum()
    assert len(vec) == 33 and vec[0] == pytest.approx(115 / 6) and vec[19] == 1.0 and vec[21:23] == [0.5, 0.3] and vec[27] == 1.0
    assert vec[31] == pytest.approx(-(p * np.log2(p)).sum()) and vec[32] == pytest.approx((mags**2).sum())
    part = features.vector(df, ["k"], ["i"], "v", ("trend",)).first().features
    assert part[:23] == [0.0] * 23 and part[23:28] == vec[23:28] and part[28:] == [0.0] * 5


ODD = {"empty": [], "one": [3.0], "two": [3.0, -1.0], "constant": [2.0] * 9, "nulls": [None] * 4, "mixed": [None, -1.0, 2.0, None, -3.0, 4.0, None]}


@pytest.mark.parametrize("name", ODD)
def test_odd_series(spark, name):
    values, w = ODD[name], S.window_of(["k"], "i")
    df, n = series(spark, values), len(values)
    for f in (anomaly.zscore, anomaly.iqr, anomaly.ensemble):
        assert f(df, ["k"], "v").count() == n
    if name == "constant":
        assert column(anomaly.zscore(df, ["k"], "v"), "score") == [0.0] * n
    for x in (S.delta(F.col("v"), w), S.rate(F.col("v"), F.col("ts"), w), S.moving_avg(F.col("v"), w, 1), S.moving_stddev(F.col("v"), w, 50), S.interpolate(F.col("v"), w), S.anomaly_score(F.col("v"), w, ["k"], 50, 1.0)):
        assert df.withColumn("x", x).count() == n
    assert S.ema(df, ["k"], ["i"], "v", 2.0).count() == n
    some = [v for v in values if v is not None]
    got = A.named(df, ["k"], {x: (x, "v") for x in ("count", "sum", "mean", "min", "max", "first", "last", "median", "p99", "stddev", "variance", "rate", "delta")}, "ts").collect()
    assert len(got) == (n > 0) and (not got or got[0]["count"] == len(some))
    if some:
        assert got[0]["min"] == min(some) and got[0]["p99"] == sorted(some)[math.floor(0.99 * (len(some) - 1) + 0.5)]
    assert features.vector(df, ["k"], ["i"], "v").count() == (n > 0)
    if None not in values:
        for model in forecast.MODELS:
            assert forecast.forecast(df, ["k"], "ts", "v", model).count() in (0, 3)


def test_durations_and_routes(spark):
    assert [durations.seconds(x) for x in ("30s", "5m", "1h", "7d", "2w", "1mo")] == [30, 300, 3600, 604800, 1209600, 2592000]
    for bad in ("5", "x", "5 fortnights", "-1h", ""):
        with pytest.raises(ValueError):
            durations.seconds(bad)
    rows = spark.createDataFrame([("",), ("a",), ("sensor-1",), (None,)], "k string")
    assert [int(r[0]) if r[0] is not None else None for r in rows.select(messages.djb2(F.col("k"))).collect()][:3] == [5381, 177670, 7572920779350877]
    assert [r[0] for r in rows.select(messages.route("hash", 3, F.col("k"))).collect()] == [2, 1, 1, 0]
    many = spark.range(900).withColumn("ts", F.timestamp_seconds(F.col("id") * 3600))
    for strategy in ("round_robin", "random", "time"):
        got = many.select(messages.route(strategy, 7, ts=F.col("ts")).alias("p")).groupBy("p").count().collect()
        assert {r.p for r in got} == set(range(7)) and min(r["count"] for r in got) > 60, strategy
    with pytest.raises(ValueError):
        messages.route("best", 3)
    encode, decode = messages.codec("json")
    assert spark.createDataFrame([('say "x"', 1)], "s string, n int").select(decode(encode("s", "n"), "s string, n int").alias("m")).first().m.s == 'say "x"'
    text = spark.createDataFrame([('say "x"; é', None)], "s string, n int").select(messages.to_json("s", "n"), messages.to_csv("s", "n", sep=";")).first()
    assert tuple(text) == ('{"s":"say \\"x\\"; é"}', '"say \\"x\\"; é";')


def test_tables(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.create(spark, path, "id int, ts timestamp_ntz, tag string, v double", "ts", ("tag",), "hour", "1d")
    rows = [(i, T0 + timedelta(minutes=7 * i), "x" if i % 3 else None, float(i)) for i in range(400)]
    tables.insert(spark, path, rows)
    tables.insert(spark, path, [])
    assert tables.describe(spark, path)["tags"] == ["tag"]
    stats = tables.table_stats(spark, path).first()
    assert stats.rows == 400 and stats.partitions == 47 and stats.bytes > 0
    assert {r.id for r in tables.read_range(spark, path, "ts", T0 + timedelta(hours=1), T0 + timedelta(hours=2)).collect()} == {9, 10, 11, 12, 13, 14, 15, 16, 17}
    to = f"{tmp_path}/kept"
    assert {r.id for r in tables.delete(spark, path, to, "tag = 'x'").collect()} == set(range(0, 400, 3))  # a null tag is not x
    assert tables.drop_expired(spark, path, T0 + timedelta(days=2), "1d") == 24
    assert tables.read(spark, path).agg(F.min("ts")).first()[0] >= T0 + timedelta(days=1)
    tables.compact(spark, path, f"{tmp_path}/compact", "2024-01-02-03")
    assert tables.table_stats(spark, f"{tmp_path}/compact").first().files == 1
    small = tables.downsample_table(spark, path, "ts", ["tag"], "v", tables.DownsampleRule("1h", "1h", "max"))
    assert tables.read(spark, small).where("tag = 'x'").count() == 23 and tables.describe(spark, small)["how"] == "max"


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    series(spark, [1.0, 2.0, 3.0]).write.parquet(src)
    seen = []
    rows = windows.stream(spark, src)
    reports = windows.run_batches(rows, lambda batch, number: seen.append((number, batch.count())), f"{tmp_path}/state")
    assert sum(n for _, n in seen) == 3
    assert windows.progress(spark, reports).agg(F.sum("input_rows")).first()[0] == 3


def test_registry(spark, tmp_path):
    rows = spark.createDataFrame([(float(i % 10), float(i), int(i % 10 > 4)) for i in range(200)], "x double, y double, label int")
    fitted = classify.train(rows, ["x", "y"], "label")
    registry.save(spark, str(tmp_path), "tree", 1, fitted, note="first")
    registry.save(spark, str(tmp_path), "tree", 2, fitted)
    assert [(r.name, r.version, r.kind) for r in registry.models(spark, str(tmp_path)).orderBy("version").collect()] == [("tree", 1, "DecisionTreeClassificationModel"), ("tree", 2, "DecisionTreeClassificationModel")]
    out = classify.report(registry.load(spark, str(tmp_path), "tree"), rows, ["label"], "decision_tree")
    assert out.where("prediction <> label").count() == 0 and out.first().classes == ["class_0", "class_1"]
    with pytest.raises(ValueError):
        registry.load(spark, str(tmp_path), "none")
