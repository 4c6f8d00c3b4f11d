"""The pipeline against its stages worked out by brute force, and each stage on odd inputs."""

import pandas as pd

import corpus_pipeline
from ledgerline.llm import quality, simhash

from .test_relations import brute_components, brute_simhash, close
from .test_text_operators import brute_spans, check_packed, ids

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_documents(spark, edge_docs):
    docs = edge_docs.selectExpr("doc_id", "text", "'en' as lang", "kept as source", "length(text) as n_chars", "kept as kept")
    for name, stage in corpus_pipeline.STAGES:
        for odd in (docs, docs.limit(0)):
            out = stage(spark, odd, SF)
            rows = out.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            assert rows == 0 if odd is not docs else rows >= 0


def test_near_duplicate_stage_keeps_one(spark):
    a = "one two three four five six seven eight"
    rows = [(5, a), (3, a), (3, a), (9, a.upper()), (7, "something else entirely different here"), (None, a), (None, "alone without id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r["text"]) for r in got) == [(0, "alone without id"), (3, a), (7, "something else entirely different here")]


def test_near_duplicate_stage_keeps_one_of_groups_that_share_an_id_or_have_none(spark):
    a, b = "one two three four five six seven eight", "nothing of this is like the other text at all"
    texts = [(i, t) for i, text in ((1, a), (None, b)) for t in (text, text.upper(), text + "\n", text.title())]
    docs = spark.createDataFrame([*texts, (1, "an id that another group has as well"), (2, a)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r["text"].strip().lower()) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == [(0, b), (1, "an id that another group has as well"), (1, a)]


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.quality(docs).where("kept").select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    fp = {i: brute_simhash(t) for i, t in kept.items()}
    order = sorted(fp)
    groups = brute_components(order, [(a, b) for a in order for b in order if a < b and close(fp[a], fp[b], simhash.RADIUS)])
    want = {}
    for i in order:
        if groups[i] == i:
            text, out, done = kept[i], [], 0
            for _, a, b in brute_spans(text):
                if b > done:
                    if a >= done:
                        out += [text[done:a], corpus_pipeline.REDACTED]
                    done = b
            want[i] = ids("".join([*out, text[done:]])) + b"\x02\x00\x00\x00"
    got = corpus_pipeline.run(spark, SF).toPandas()
    check_packed(got, 1024)
    whole = got.sort_values("piece").groupby("doc_id")["ids"].agg(lambda parts: b"".join(map(bytes, parts)))
    assert pd.Series(whole).to_dict() == want
