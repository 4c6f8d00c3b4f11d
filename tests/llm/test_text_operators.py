"""Operators on single documents against brute force: tokens, edits, quality, secrets."""

import collections
import hashlib
import random
import re
import string
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import bpe, edits, packing, quality, secrets, tokens

LIBRARY = Tokenizer.from_file(bpe.default_vocabulary())
ALPHABET = ["'", "s", "re", "ll", " ", "  ", "\n", "\t", "a", "é", "日", "　", " ", " ", "\u0085", "1", "!", "€",
            "<|endoftext|>", "<|endof", "😀", "\x1c", "‍", "́", "ह", "Z", "don't", "…", "½", "\r"]
SF = "/root/testdata/sf0.001"


def ids(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=20).map("".join))
def test_forced_boundaries_give_the_library_ids(text):
    coder = bpe.encoder(bpe.default_vocabulary())
    import pyarrow as pa

    (packed,) = coder.encode_array(pa.array([text]))
    assert packed == ids(text)
    assert coder.decode(packed) == LIBRARY.decode(np.frombuffer(packed, "<u4").tolist(), skip_special_tokens=False)


def test_encode_and_decode(spark, edge_docs):
    coded = tokens.encode(edge_docs)
    assert coded.columns == ["doc_id", "kept", "ids"]
    rows = edge_docs.toPandas()
    got = sorted(bytes(r.ids) for r in coded.collect())
    assert got == sorted(ids(t or "") for t in rows["text"])
    back = tokens.decode(coded).toPandas()
    assert sorted(back["text"]) == sorted(t or "" for t in rows["text"])
    assert tokens.encode(edge_docs.limit(0)).count() == 0
    both = tokens.round_trip(edge_docs).toPandas()
    assert sorted(map(bytes, both["ids"])) == got and sorted(both["decoded"]) == sorted(back["text"])
    assert tokens.round_trip(edge_docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32))
def test_edited_trees_count_like_the_library(seed):
    rng = random.Random(seed)
    pick = lambda n: "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, n)))
    text, count = pick(25), lambda s: len(ids(s)) // 4
    words = edits.leaves(text)
    tree = edits.TokenTree(words, [count(w) for w in words], count)
    for _ in range(rng.randint(1, 4)):
        start = rng.randint(-1, len(text) + 1)
        end, new = start + rng.randint(0, 6), pick(3)
        tree.edit(start, end, new)
        a = min(max(start, 0), len(text))
        b = min(max(end, a), len(text))
        text = text[:a] + new + text[b:]
        assert (tree.text(), tree.total) == (text, count(text))


def test_edits_on_tables(spark, edge_docs):
    counted = edits.masked_counts(edge_docs).toPandas()
    assert len(counted) == edge_docs.count() and "kept" in counted
    assert (counted["tokens_before"] == counted["tokens_after"]).all() and (counted["n_edits"] == 0).all()
    mail = spark.createDataFrame([(1, "write to a.b@c.example or +1 (528) 555-3435 now")], "doc_id long, text string")
    row = edits.apply_edits(edits.token_trees(edits.mask_edits(mail))).collect()[0]
    assert row["text"] == "write to <EMAIL> or <NUMBER> now" and row.n_edits == 2
    assert row.tokens_after == len(ids(row["text"])) // 4 == sum(row.leaf_tokens)
    assert edits.masked_counts(edge_docs.limit(0)).count() == 0
    again = edits.apply_edits(edits.apply_edits(edits.token_trees(edits.mask_edits(mail))).drop("edits").selectExpr("*", "null as edits").withColumn("edits", edits.F.lit(None).cast(edits.EDITS)))
    assert again.collect()[0].tokens_after == row.tokens_after


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute_distances(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def js(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        half = lambda x: sum(a * np.log2(a / c) for a, c in zip(x, m) if a > 0)
        return np.sqrt(max(0.0, (half(p) + half(q)) / 2))

    best = None
    for language in quality.COMMON_WORDS:
        q = quality.word_reference(language)
        p = {w: words.count(w) / len(words) for w in q}
        d = js([*p.values(), 1 - sum(p.values())], [*q.values(), 1 - sum(q.values())])
        best = d if best is None else min(best, d)
    return best


def test_quality_against_brute_force(spark, edge_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = quality.quality(docs).toPandas()
    for r in got.itertuples():
        want = brute_quality(r.text)
        assert tuple(getattr(r, n) for n in NAMES) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        if want[0] >= quality.MIN_COMMON_WORDS:
            assert r.word_distance == pytest.approx(brute_distances(r.text), abs=1e-9)
    edge = quality.quality(edge_docs).toPandas()
    assert len(edge) == edge_docs.count() and not edge["base_failed"].isna().any() and not edge["kept"].isna().any()
    assert not edge.loc[edge["text"].isna(), "kept"].any()
    assert quality.quality(edge_docs.limit(0)).count() == 0


def test_quality_keeps_clean_documents_and_drops_junk(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    got = quality.quality(docs).where("not base_failed").toPandas()
    assert got.loc[got.quality == 1, "kept"].mean() > 0.99
    assert got.loc[got.quality == 0, "kept"].mean() < 0.2


def brute_spans(text):
    cased = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    name = "|".join(map(cased, ("password", "passwd", "secret", "token", "api_?key")))
    assign = re.compile(rf"""(?:{name})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, b, k in sorted(spans)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "PASSWORD", "ſecret", "api_key", "apiKey", "=", ":", " ", '"', "AKIA", "ABCDEF0123456789", "0123456789abcdef", "é", "a" * 25, ".", "\n"]), max_size=14).map("".join))
def test_base_spans(text):
    assert [tuple(s) for s in secrets.scan(text)[0]] == brute_spans(text)


def test_grammar_learns_a_format():
    rng = random.Random(4)
    keys = ["sk-" + "".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(300)]
    words = ["".join(rng.choice(["th", "er", "on", "an", "ing", "wh"]) for _ in range(11)) for _ in range(300)]
    model = secrets.Model((secrets.infer(keys[:200]),), secrets.Ordinary(words[:200]))
    assert sum(map(model.secret, keys[200:])) >= 95
    assert not any(map(model.secret, words[200:]))
    assert secrets.infer([]) is None and not secrets.Model((), secrets.Ordinary([])).secret("x" * 30)


def test_secrets_on_tables(spark, edge_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = secrets.fit(docs)
    got = secrets.with_spans(docs, model, redact="[S]").toPandas().set_index("doc_id")
    for r in docs.toPandas().itertuples():
        spans = [tuple(s) for s in got.loc[r.doc_id, "spans"]]
        assert [s for s in spans if s[0] != "grammar"] == brute_spans(r.text)
        assert (got.loc[r.doc_id, "text"] == r.text) == (not spans)
    edge = secrets.with_spans(edge_docs, secrets.fit(edge_docs), redact="[S]").toPandas()
    assert len(edge) == edge_docs.count() and edge["text"].isna().sum() == 2
    assert secrets.with_spans(edge_docs.limit(0), secrets.fit(edge_docs.limit(0))).count() == 0
    one = spark.createDataFrame([("a token = abcdef0123456789abcdef0123456789 end",)], "text string")
    assert secrets.with_spans(one, model, redact="[S]").collect()[0]["text"] == "a [S] end"


def test_fit_finds_bare_keys_where_they_are_most_long_runs(spark):
    rng = random.Random(7)
    key = lambda: "".join(rng.choices(string.ascii_letters + string.digits, k=32))
    bare = [key() for _ in range(600)]
    prose = "in this house the old clerk wrote a letter to Mr Brown on 12 May about well-known matters of state/church"
    usual = "thanbleshaningtionnterberbeeinheitkeiter"
    rows = [(f"{prose} {k} {usual} token={key()} end",) for k in bare]
    docs = spark.createDataFrame(rows, "text string").repartition(5)
    got = secrets.with_spans(docs, secrets.fit(docs), redact="[S]").collect()
    assert sum(k in r["text"] for k in bare for r in got) <= 6
    assert all(usual in r["text"] and prose in r["text"] for r in got)


def test_word_pairs_against_brute_force(monkeypatch):
    text = "é ab1 " + "k" * 25 + " Z-9 token=abcdef12 ü2x\n/a"
    want = {}
    for word in ("ab1", "Z-9", "2x", "/a"):
        for before, c in zip(["", *map(secrets.symbol, word)], map(secrets.symbol, word)):
            want[before + c] = want.get(before + c, 0) + 1
    for size in (1, 3, 1 << 20):
        monkeypatch.setattr(secrets, "COUNT_BYTES", size)
        n = secrets.word_pairs(text, secrets.scan(text)[0])
        names = ["", *secrets.SYMBOLS]
        assert {names[i // 16] + names[i % 16]: n[i] for i in n.nonzero()[0] if i % 16} == want


def test_op4_digests(spark):
    got = secrets.op4_secret_grammars(spark, SF).toPandas().set_index("doc_id")
    for r in pd.read_parquet(f"{SF}/documents.parquet").itertuples():
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(r.text))
        assert got.loc[r.doc_id, "base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()


def test_best_fit_rounds_fill_gaps():
    placed, sequences = packing.best_fit_rounds({6: 3, 4: 3, 3: 2, 2: 1, 1: 4}, 10)
    assert sequences == 5  # 18 + 12 + 6 + 2 + 4 = 42 tokens
    with pytest.raises(ZeroDivisionError):
        packing.best_fit_rounds({11: 1}, 10)


def check_packed(rows, capacity):
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g["length"].cumsum() - g["length"]).tolist() == g["offset"].tolist() and g["length"].sum() <= capacity


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(0, 40), max_size=16))
def test_rounds_place_every_rank_once(counts):
    placed, sequences = packing.best_fit_rounds(counts, 16)
    rows = []
    for i, p in enumerate(placed):
        same = sorted(q.first_rank for q in placed if q.length == p.length)
        end = next((f for f in same if f > p.first_rank), counts[p.length])
        for k in range(end - p.first_rank):
            rows.append((p.length, p.first_sequence + k // p.each, p.offset + k % p.each * p.length))
    df = pd.DataFrame(rows, columns=["length", "sequence_id", "offset"])
    assert df["length"].value_counts().to_dict() == {k: v for k, v in counts.items() if v}
    check_packed(df, 16)
    assert df["sequence_id"].nunique() == sequences if rows else sequences == 0


def test_packing(spark, edge_docs):
    pieces = packing.materialise(packing.token_pieces(edge_docs), "pieces")
    got = packing.pack(pieces, "length", ["doc_id", "piece"]).toPandas()
    check_packed(got, 1024)
    assert got["length"].sum() == sum(len(ids(t or "")) // 4 + 1 for t in edge_docs.toPandas()["text"])
    assert all(zlib.crc32(bytes(i)) == c for i, c in zip(got["ids"], got["ids_crc32"]))
    long = got[got.doc_id == 5].sort_values("piece")
    assert (long["length"].iloc[1:] == 1024).all() and (long["start"] == long["length"].cumsum() - long["length"]).all()
    empty = packing.materialise(packing.token_pieces(edge_docs.limit(0)), "pieces")
    assert packing.pack(empty, "length", ["doc_id", "piece"]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(pieces, "start", ["doc_id", "piece"])
