"""Queries with SQL give what DuckDB gives; op4's digest of spans is that of the spans."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from helpers import collect
from pareframe.llm import pieces
from pareframe.llm.queries import model_path, oracle_sql, queries
from pareframe.sources.tables import table


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, sf_dir, name):
    duck = duckdb.connect()
    for file in os.listdir(sf_dir):
        duck.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    expected = duck.sql(oracle_sql()[name])
    rows = queries()[name](spark, sf_dir)
    assert sorted(rows.columns) == sorted(expected.columns)
    assert sorted(map(tuple, rows.select(*expected.columns).collect()), key=str) == sorted(expected.fetchall(), key=str)


def test_digests_of_spans(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").limit(60).cache()
    spans = {r["doc_id"]: np.array([r["begins"], r["ends"]], "<i8") for r in collect(pieces.encode_documents(documents, model_path()))}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in collect(documents)}
    for r in collect(pieces.encoding_report(documents, model_path())):
        begins, ends = spans[r["doc_id"]]
        assert r["spans_sha256"] == hashlib.sha256(spans[r["doc_id"]].tobytes()).hexdigest()
        assert b"".join(texts[r["doc_id"]][a:b] for a, b in zip(begins, ends, strict=True)) == texts[r["doc_id"]]
