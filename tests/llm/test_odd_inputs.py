"""Odd and very long inputs, and queries against brute force over whole tables."""

import json
import random
import re
import string
import time

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import edits, secrets, tools

from .test_text_operators import ids

SF = "/root/testdata/sf0.001"
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LABELLED = "conv_id long, call_id string, turn long, name string, arguments string, after string"
ANSWERED = "conv_id long, call_id string, turn long, content string"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", ".", "@", "b-c", "_", " ", "%", "é", "x@y.z"]), max_size=14).map("".join))
def test_addresses(text):
    assert list(edits.addresses(text)) == [m.span() for m in MAIL.finditer(text)]


def test_long_texts_take_seconds():
    began = time.monotonic()
    word = "w" * 5_000_000
    assert not list(edits.addresses(word)) and not list(edits.addresses("a@" * 1_000_000))
    model = secrets.Model((secrets.infer(["ab12" * 6]),), secrets.Ordinary(["word"]), 5.0, 6)
    assert not secrets.find(word, model)
    many = "token=abcdef1234 x1y2z3a4b5 " * 60_000
    assert sum(s.kind == "assign" for s in secrets.find(many, model)) == 60_000
    assert time.monotonic() - began < 60


def brute_outside(runs, spans):
    inside = {i for a, b in spans for i in range(a, b)}
    found = []
    for a, b in runs:
        part = []
        for i in [*range(a, b), None]:
            if i is not None and i not in inside:
                part.append(i)
            elif part:
                found.append((part[0], part[-1] + 1))
                part = []
    return found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=6), st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=6))
def test_what_spans_leave_of_runs(run_sizes, span_sizes):
    runs, at = [], 0
    for gap, size in run_sizes:
        runs.append((at + gap % 3 + 1, at + gap % 3 + 1 + size))
        at = runs[-1][1]
    spans = sorted((a, a + n) for a, n in span_sizes)
    text = "x" * 200
    got = secrets.outside(text, [secrets.Span("grammar", *r) for r in runs], [secrets.Span("assign", *s) for s in spans])
    assert [(s.start, s.end) for s in got] == brute_outside(runs, spans)


def test_unlabelled_credentials_of_labelled_formats_are_found(spark):
    rng = random.Random(11)
    key = lambda: "sk-" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=14))
    prose = "the old clerk wrote a letter about well-known matters of state in May and read it twice"
    rows = [(i, f"{prose} token={key()} and so on") for i in range(300)]
    bare, named, joined = [key() for _ in range(40)], [key() for _ in range(40)], [key() for _ in range(40)]
    rows += [(1000 + i, f"{prose} {k} {prose}") for i, k in enumerate(bare)]
    rows += [(2000 + i, f"{prose} AUTH_HEADER={k} {prose}") for i, k in enumerate(named)]
    rows += [(3000 + i, f"{prose} 0123456789abcdef01234567/{k}") for i, k in enumerate(joined)]
    rows += [(4000, None), (4001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = secrets.fit(docs)
    assert model.least == 17 and model.prior > 0
    got = {r.doc_id: r for r in secrets.with_spans(docs, model, redact="[S]").collect()}
    lost = [k for at, keys in ((1000, bare), (2000, named), (3000, joined)) for i, k in enumerate(keys) if k in got[at + i]["text"]]
    assert len(lost) <= 4
    assert all(prose in r["text"] for r in got.values() if r["text"])
    assert "AUTH_HEADER=" in got[2000]["text"]


def test_arguments_that_no_canonical_json_can_hold(spark):
    deep = "[" * 2000 + "]" * 2000
    calls = [(1, "a", 1, "search", '{"query":"\\ud800"}', None), (1, "b", 1, "search", '{"query":' + deep + "}", None), (1, "c", 1, "search", '{"query":"\\ud83d\\ude00"}', None)]
    results = [(1, x, 2, "r") for x in "abc"]
    got = {r.call_id: r for r in tools.link_calls(spark.createDataFrame(calls, LABELLED), spark.createDataFrame(results, ANSWERED)).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "bad_json", "b": "bad_json", "c": "ok"}
    assert json.loads(got["a"].message)["call"]["arguments"] == calls[0][4]
    assert json.loads(got["b"].message)["call"]["arguments"] == calls[1][4]


def test_conversations_that_number_their_calls_alike(spark):
    q = '{"query":"x"}'
    calls = [(1, "c1", 1, "search", q, None), (2, "c1", 1, "search", q, None), (2, "c2", 3, "search", q, "c1"), (None, "c1", 1, "search", q, None), (3, None, 1, "search", q, None)]
    results = [(1, "c1", 2, "one"), (2, "c1", 2, "two"), (2, "c2", 4, "three"), (4, "c1", 2, "four")]
    got = tools.link_calls(spark.createDataFrame(calls, LABELLED), spark.createDataFrame(results, ANSWERED), per_conversation=True).collect()
    rows = {(r.conv_id, r.call_id): (r.depth, r.status, r.n_calls, r.n_results) for r in got}
    assert rows == {(1, "c1"): (0, "ok", 1, 1), (2, "c1"): (0, "ok", 1, 1), (2, "c2"): (1, "ok", 1, 1), (None, "c1"): (0, "no_result", 1, 0), (4, "c1"): (None, "no_call", 0, 1)}
    assert all(json.loads(r.message)["result"]["content"] == {1: "one", 2: {"c1": "two", "c2": "three"}.get(r.call_id), 4: "four"}[r.conv_id] for r in got if r.n_results)
    empty = spark.createDataFrame([], LABELLED)
    assert tools.link_calls(empty, spark.createDataFrame([], ANSWERED), per_conversation=True).count() == 0


def test_op6_equals_brute_force(spark):
    turns = pd.read_parquet(f"{SF}/conversations.parquet")
    calls, results = {}, {}
    for r in turns.itertuples():
        if r.role == "user":
            calls.setdefault((r.conv_id, r.turn), []).append(r.text)
        elif r.role == "assistant":
            results.setdefault((r.conv_id, r.turn - 1), []).append((r.turn, r.text))
    want = {}
    for at in calls.keys() | results.keys():
        depth, status, message = None, "no_call", None
        if at in calls:
            depth = 0
            while (at[0], at[1] - 2 * depth - 2) in calls:
                depth += 1
            text = min(calls[at], key=lambda t: len(t) > 200) if len(calls[at]) == 1 else None
            short = text is not None and len(text) <= 200
            bad = text == ""
            status = "no_result" if at not in results else "bad_arguments" if bad else "ok"
            if text is not None:
                message = {"query": text, "limit": 10} if short else {"text": text, "words": 50}
        want[f"call-{at[0]}-{at[1]}"] = (depth, status, len(calls.get(at, [])), len(results.get(at, [])), message)
    got = tools.op6_tool_call_linking(spark, SF).collect()
    assert {r.call_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        depth, status, n_calls, n_results, arguments = want[r.call_id]
        assert (r.depth, r.status, r.n_calls, r.n_results) == (depth, status, n_calls, n_results), r
        message = json.loads(r.message)
        assert r.message == json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        if arguments is not None:
            assert message["call"]["arguments"] == arguments
        if n_results == 1:
            conv, turn = map(int, r.call_id.split("-")[1:])
            assert message["result"]["content"] == results[conv, turn][0][1]


def test_op1_numbers_equal_the_library(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"]
    number = re.compile(r"\+?\(?[0-9](?:[0-9() -]{5,}[0-9])")
    for r in edits.op1_edit_aware_counts(spark, SF).collect():
        text = docs[r.doc_id] or ""
        spans = [(*m.span(), "<EMAIL>") for m in MAIL.finditer(text)]
        spans += [(*m.span(), "<NUMBER>") for m in number.finditer(text) if all(m.end() <= a or b <= m.start() for a, b, _ in spans)]
        after = text
        for a, b, mask in sorted(spans, reverse=True):
            after = after[:a] + mask + after[b:]
        assert (r.n_edits, r.tokens_before, r.tokens_after, r.chars_after) == (len(spans), len(ids(text)) // 4, len(ids(after)) // 4, len(after))
        assert r.encoded_chars <= len(after) and (r.encoded_chars > 0) == bool(spans)
