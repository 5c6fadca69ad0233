"""Corpus queries against their SQL in DuckDB, and their registration."""

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    text = lambda df: sorted("|".join(map(str, r)) for r in df[order].itertuples(index=False))
    assert text(got) == text(want)


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_held_out_accuracy(spark):
    """Language and quality on rows that training did not see."""
    from pyspark.sql import functions as F

    q = queries.queries()
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = q["op1_ppm_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(docs.where("lang IS NOT NULL"), "doc_id")
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97
    found = q["op4_discriminant_quality"](spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id")
    assert found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
