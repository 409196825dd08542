"""The registered corpus queries against their SQL on the smallest tables, and the pipeline stage by stage."""

import os

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from patternloom.llm import queries as q
from patternloom.llm._common import shared_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query(spark, duck, name):
    got = q.queries()[name](spark, SF)
    want = duck.sql(q.SQL[name])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_scored_queries_return_every_document(spark):
    n = pd.read_parquet(f"{SF}/documents.parquet")["doc_id"].nunique()
    for name in ("op2_language_id", "op4_toxicity", "op8_simhash", "op9_quality"):
        assert q.queries()[name](spark, SF).where("doc_id is not null").select("doc_id").distinct().count() == n  # op2 has rows of pages too


def test_pipeline(spark):
    """Each stage's rows are those that the stage's operator keeps of its predecessor's, and columns stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).toPandas()
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, SF)
        assert after.columns == docs.columns
        assert set(after.toPandas()["doc_id"]) <= set(left.toPandas()["doc_id"])
        left = shared_table(after, name)
    rows = left.toPandas()
    text = rows["text"].str.lower()
    assert text.is_unique
    words = rows.set_index("doc_id")["text"].map(lambda t: len(t.encode().split()))
    assert out.groupby("doc_id")["length"].sum().to_dict() == words[words > 0].to_dict()
