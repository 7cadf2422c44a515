"""The named queries run, agree with their SQL twins, and the pipeline's stages keep their contract."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from openchair.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twins(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True).astype(str) for x in (got, want))
    assert got.equals(want)


def test_registered():
    assert {f"op{n}_" for n in range(1, 11)} <= {name.split("_")[0] + "_" for name in entry.queries()}
    assert "pipeline" in entry.queries()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas(), docs.schema)
        assert docs.columns == columns
        after = docs.count()
        assert 0 < after <= before
        if name == "secret_scan":
            assert after == before
        before = after
    packed = corpus_pipeline.pack_sequences(spark, docs, SMALL).toPandas()
    assert set(packed.doc_id) == {row.doc_id for row in docs.select("doc_id").collect()}


def test_near_duplicates_of_repeated_and_null_ids(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(6)]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (3, texts[0] + " tail"), (None, texts[2]), (None, texts[2])]
    rows += [(None, texts[3]), (None, texts[4] + " tail"), (9, texts[4]), (8, texts[5]), (5, None)]
    docs = spark.createDataFrame([(*row, "x") for row in rows], "doc_id bigint, text string, lang string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    wanted = [(7, texts[1]), (3, texts[0] + " tail"), (None, texts[2]), (None, texts[3]), (9, texts[4]), (8, texts[5]), (5, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(wanted, key=str)
