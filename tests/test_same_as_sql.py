"""Queries against their DuckDB SQL on texts where patterns of Java and of DuckDB could part."""

import duckdb
import pytest

import __spark_entry__

ODD = [
    "The SS\u00f6 and \u00c9AI and \u00c9O and SAs\u00f6 met the QRS board.",
    "We saw \u00e9AB, AB\u00e9, AB_C, AB1, (XYZ) and XYZs with \u015aSA or \u00dfQQ and RRR, TTT.",
    "One\u000bor two, three\u000band four, five and six, seven.\u000bThen e.g.\u000beight. Nine",
    None,
    "",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(k, t, "en", "web", len(t or "")) for k, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["r16_undefined_acronyms", "r29_findings", "r18_inline_lists", "c16_ranked_findings", "a1_score_components", "a3_score_web_copy"])
def test_same_rows_as_sql(spark, odd, name):
    got = __spark_entry__.queries()[name](spark, odd)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet/*.parquet')")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
