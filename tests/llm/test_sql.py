"""The operators' SQL against their queries, on the smallest tables and on odd ones."""

import os

import duckdb
import pytest
from odd import labels, odd_documents

from rasterloom.llm import queries, sql

SF = "/root/testdata/sf0.001"


def same(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    want = con.sql(sql.ORACLE[name]).fetchall(), con.sql(sql.ORACLE[name]).columns
    got = queries.QUERIES[name](spark, sf_dir).select(*want[1])
    shown = lambda rows: sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    assert sorted(got.columns) == sorted(queries.QUERIES[name](spark, sf_dir).columns)
    assert shown(got.collect()) == shown(want[0])


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_against_sql(spark, name):
    same(spark, SF, name)


@pytest.mark.parametrize("name", ["op3_mixing", "op6_quality_rules"])
def test_odd_documents_against_sql(spark, tmp_path, name):
    odd_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    same(spark, str(tmp_path), name)
