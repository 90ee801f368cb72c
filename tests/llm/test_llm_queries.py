"""The registered queries against their SQL, and the pipeline against its stages."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tapeworks.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def canonical(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted((tuple(int(v) if isinstance(v, float) and v.is_integer() else v for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expect = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(expect.columns) and len(got)
    assert canonical(got) == canonical(expect)


def test_every_operator_has_a_query():
    assert [next(q for q in QUERIES if q.startswith(f"op{n}_")) for n in range(1, 14)]


def test_pipeline(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, sizes = documents, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == documents.columns, name
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        sizes.append(docs.count())
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0")
    first = spark.read.parquet(f"{tmp_path}/0")
    lost = labels.join(documents, "doc_id", "left_semi").join(first, "doc_id", "left_anti").count()
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3] > 0 and lost <= 2
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = corpus_pipeline.run(spark, SF).select(columns).toPandas()
    steps = docs.select(columns).toPandas()
    pd.testing.assert_frame_equal(whole.sort_values(columns).reset_index(drop=True), steps.sort_values(columns).reset_index(drop=True))
