"""Every registered core query against its SQL."""

import pytest

from quillon import queries

from .oracle import check


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    check(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_chunks_join_to_the_text(spark, sf_dir):
    import hashlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.QUERIES["string_chunk"](spark, sf_dir).collect():
        assert r["id"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest() and r["most"] <= 64
