"""Columns of documents whose names the stages use themselves keep their values."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
CLASHING = ["kept", "spans", "n_words", "__key", "__row", "__n", "fp", "root", "class_distance", "base_failed", "component_id", "first", "a.b"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_clashing_columns_keep_their_values(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    more = [f"concat('{c} of ', doc_id) as `{c}`" for c in CLASHING]
    docs = plain.selectExpr("*", *more)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and out.schema["kept"].dataType == docs.schema["kept"].dataType
    got = {r.doc_id: r.asDict() for r in out.collect()}
    want = {r.doc_id: r.asDict() for r in stage(spark, plain, SF).collect()}
    assert set(got) == set(want)
    for i, row in got.items():
        assert all(row[c] == f"{c} of {i}" for c in CLASHING)
        assert all(row[c] == want[i][c] for c in plain.columns)


def test_numbers_of_characters_keep_their_type(spark):
    docs = spark.createDataFrame([(1, "a token = abcdef0123456789 end", 30, "x"), (2, None, None, "y")], "doc_id long, text string, n_chars int, spans string")
    got = {r.doc_id: r for r in corpus_pipeline.secret_scans(spark, docs, SF).collect()}
    assert (got[1]["text"], got[1].n_chars, got[1].spans) == ("a [SECRET] end", 14, "x")
    assert (got[2]["text"], got[2].n_chars, got[2].spans) == (None, None, "y")


def test_rows_that_differ_in_other_columns_alone(spark):
    docs = spark.createDataFrame([(1, "one two three four five", b) for b in ("z", "y", None)], "doc_id long, text string, fp string")
    assert [r.fp for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()] == [None]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_without_an_order(spark, name):
    text = (
        "the cat and the dog are in this garden of ours today and nothing else is to be seen from the house that we have had for "
        "all these years with its red door and the old tree that was here when they first came to the town by the river and that "
        "is not to say it was a quiet place for there was work to do on the farm and in the mill "
    )
    docs = spark.range(6).selectExpr(
        "id div 2 AS doc_id", f"concat('{text}', id div 2) AS text", "map(id, map('a', id)) AS m", "parse_json(concat('{\"a\": ', id, '}')) AS v",
        "array(struct(map('x', id) AS deep)) AS s", "CASE WHEN id > 3 THEN map('k', id) END AS n", "'en' AS lang", "1 AS n_chars",
    )
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert out.dtypes == docs.dtypes
    rows = out.selectExpr("doc_id", "m", "to_json(v) AS v", "s", "n").collect()
    if name == "near_duplicates":
        assert len(rows) == 1 and (rows[0].m, rows[0].v, rows[0].s[0].deep) == ({0: {"a": 0}}, '{"a":0}', {"x": 0})
    else:
        assert len(rows) == 6 and {r.v for r in rows} == {f'{{"a":{i}}}' for i in range(6)}
