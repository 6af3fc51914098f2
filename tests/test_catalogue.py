import math

import duckdb
import pytest

from docgrain.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, con, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    expected = con.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].astype(object).where(df[columns].notna(), None).values.tolist())
    assert rows(got) == rows(expected)


def test_every_query_has_sql_and_the_entry_imports():
    import __spark_entry__

    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_png_predict_roundtrip_keeps_vectors_of_any_length(spark, tmp_path):
    rows = [(i, [0.01 * k - 0.1 for k in range(n)]) for i, n in enumerate((8, 5, 64, 1, 13))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.QUERIES["png_predict_roundtrip"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(i, True, True) for i in range(5)]
