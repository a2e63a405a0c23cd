"""Registered corpus queries: against DuckDB where SQL can say the same, else their shape."""

import duckdb
import pytest
from conftest import SF, bag

from tallyshelf.llm import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()
COLUMNS = {
    "op4_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op6_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op12_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_language_id": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


def test_thirteen_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) == set(ORACLE) | set(COLUMNS)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, duck, name):
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    expected = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert bag(df) == expected and expected


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_shape(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    if "doc_id" in COLUMNS[name]:
        ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
        assert sorted(r.doc_id for r in rows) == sorted(ids)


def test_mixing_runs_no_python(spark):
    plan = QUERIES["op10_mixing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
