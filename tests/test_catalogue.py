"""Every query against its SQL in DuckDB, as the driver compares them."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from chronolith.plans import catalogue

SF = "/root/testdata/sf0.01" if os.environ.get("CATALOGUE_SF") is None else os.environ["CATALOGUE_SF"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows_of(pdf: pd.DataFrame) -> list:
    cols = sorted(pdf.columns)
    return sorted(pdf[cols].astype(object).where(pdf[cols].notna(), None).itertuples(index=False, name=None), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b) and len(a) > 0
    for x, y in zip(a, b, strict=True):
        assert [str(v) for v in x] == [str(v) for v in y] or list(x) == list(y)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", ["classify_decision_tree", "classify_random_forest", "classify_logistic_regression"])
def test_classifiers_use_every_component(spark, tmp_path, name):
    rows = [(i, i % 2, [float(i * k % 7) for k in range(63)] + [float(i % 2)]) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert all(r.prediction == r.label for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect())


def test_spine_by_user_has_every_user(spark):
    out = catalogue.QUERIES["bucket_fill_spine_by_user"](spark, SF)
    assert out.select("user_id").distinct().count() == catalogue.events(spark, SF).select("user_id").distinct().count() > 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
