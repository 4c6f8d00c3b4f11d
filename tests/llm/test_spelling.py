"""Spelling variants against brute force over deletions, on a table and on generated words."""

import collections
import random
import re
import zlib

import pandas as pd

from ledgerline.llm import spelling

SF = "/root/testdata/sf0.001"


def counted(rows):
    low, c = str.maketrans(spelling.UPPER, spelling.UPPER.lower()), collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            c[run[:k] + run[k + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in c.items() if n >= 5 and len(w) >= 6}


def brute(n):
    near, gaps = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            gaps[k, short].add(w)
            if short in n:
                near[w].add(short)
                near[short].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def result(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    assert result(spelling.op13_variable_gram_variants(spark, SF)) == brute(counted(zip(docs["doc_id"], docs["text"])))


def test_chains_clusters_and_few_grams(spark, table, monkeypatch):
    """Few letters and repeated parts, so that most grams are frequent; a small dictionary; chains of forms."""
    draw = random.Random(5)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(6, 9))) for _ in range(700)}
    words |= {"ab" * k for k in range(3, 8)} | {"a" * k for k in range(6, 14)} | {"x" * 3000, "x" * 3001}
    chain = ["follow", "followe", "followed", "followedx", "followedxy"]
    n = {w: draw.choice([5, 6, 30, 200]) for w in words} | {w: 5 * 5**i for i, w in enumerate(chain)} | {"fillow": 4}
    occurring = table(list(n.items()), "word string, n int").selectExpr("explode(array_repeat(word, n)) AS word")
    want = brute({w: k for w, k in n.items() if k >= 5})
    for size in (spelling.DICTIONARY, 50, 0):
        monkeypatch.setattr(spelling, "DICTIONARY", size)
        assert result(spelling.group_variants(occurring)) == want
    assert want["follow"][1] == "followedxy"


def test_bound_holds_for_every_single_edit():
    """Each word shares one of its rare grams, a place apart at most, with every word one edit away."""
    draw, frequent = random.Random(8), {}
    for q in range(2, 6):
        frequent |= {"".join(draw.choice("^ab") for _ in range(q)): draw.randint(20, 90) for _ in range(60)}
        frequent |= {"a" * q: 99, "b" * q: 50, "ab" * (q // 2): 40}
    for _ in range(400):
        w = "".join(draw.choice("ab") for _ in range(draw.randint(6, 12)))
        k, c = draw.randrange(len(w)), draw.choice("abc")
        for near in (w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :]):
            if len(near) >= 6:
                mine, other = spelling.rare_grams(w, frequent), spelling.rare_grams(near, frequent)
                assert any(g == h and abs(p - q) <= 1 for g, p in mine for h, q in other), (w, near)


def test_odd_rows(spark, edge_docs, table):
    n = collections.Counter(r["word"] for r in spelling.occurrences(edge_docs).collect())
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert {w: k for w, k in n.items() if k >= 5} == counted(rows)
    assert result(spelling.group_variants(spelling.occurrences(edge_docs))) == brute(counted(rows))
    assert result(spelling.group_variants(spelling.occurrences(edge_docs.limit(0)))) == {}
    text = "Straße STRASSE straßen ÉCOLES écoles x×y÷zabc " * 10
    docs = table([(i, t, "x", "y") for i, t in ((None, text), (7, text), (7, text), (8, None))], "doc_id long, text string, word string, n string")
    got = result(spelling.group_variants(spelling.occurrences(docs)))
    assert got == brute(counted([(None, text), (7, text), (7, text)]))
    assert {"Écoles", "écoles", "x×y÷zabc", "strasse"} <= set(got)
