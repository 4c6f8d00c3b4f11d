"""Operators on pairs, archives, chats and layouts against brute force."""

import hashlib
import json
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from ledgerline.llm import components, neighbours, sharding, simhash, tools, warc
from ledgerline.llm.common import scratch_path

SF = "/root/testdata/sf0.001"


def brute_components(nodes, linked):
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        ra, rb = root(a), root(b)
        label[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)]
    pairs += [(k, k + 1) for k in range(100, 140)] + [(200, 200 + k) for k in range(50)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs + [(None, 3)], "a long, b long")).collect()}
    want = brute_components({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if k != v}


def brute_simhash(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_of_texts(monkeypatch):
    texts = [None, "", " \n", "one", "Two Words", "a b c", "É A b\x0bc\x1cd e f", "x y z " * 500]
    want = [brute_simhash(t) for t in texts]
    assert [simhash.simhash(t) for t in texts] == want
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 7)
    assert [simhash.simhash(t) for t in texts] == want


def close(x, y, radius):
    return bin(int(x) ^ int(y)).count("1") <= radius


@pytest.mark.parametrize(("radius", "tree_size"), [(3, 1024), (3, 4), (1, 2)])
def test_links_connect_what_is_near(spark, radius, tree_size):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(30)]
    x = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (2**64 - 1) for b in base for _ in range(8)} | {0, 7}
    signed = sorted(v - 2**64 if v >> 63 else v for v in x)
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, tree_size).collect()
    near = [(a, b) for a in signed for b in signed if a < b and close(a % 2**64, b % 2**64, radius)]
    assert brute_components(signed, [(r.a, r.b) for r in found]) == brute_components(signed, near)
    assert len(found) < 40 * len(signed)


def test_more_blocks_lose_nothing():
    rng = random.Random(9)
    for n in (10, 2**23, 2**31, 2**40):
        masks = simhash.shard_masks(n, 3)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for _ in range(3):
                y ^= 1 << rng.randrange(64)
            assert any(x & m == y & m for m in masks)


def test_near_duplicates(spark, edge_docs):
    got = simhash.near_duplicates(edge_docs).toPandas()
    assert len(got) == edge_docs.count()
    by = {(None if pd.isna(r.doc_id) else r.doc_id): r.component_id for r in got.itertuples() if not pd.isna(r.doc_id)}
    assert by[7] == by[1] == 1 and by[2] == by[3] == by[4] == 2
    assert simhash.near_duplicates(edge_docs.limit(0)).count() == 0
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    fp = {i: brute_simhash(t) for i, t in zip(docs.doc_id, docs.text)}
    ids = sorted(fp)
    want = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and close(fp[a], fp[b], 3)])
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash_bk_tree(spark, SF).collect()}
    assert out == {i: (format(fp[i], "016x"), want[i]) for i in ids}


def test_warc(spark, tmp_path):
    big = "p" * 150
    rows = [(3, "http://a b\r\n", big), (1, "u", big), (2, None, big), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
            (None, "u", big), (8, "u", "é" * 60), (8, "u", "é" * 60)]
    rows += [(100 + i, "u", f"<html>page number {i} of many</html>" * 20) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash")).coalesce(2)
    archives = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_archives(archives).toPandas()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got.itertuples()}
    assert by[1].record_type == "response" and by[2].refers_to == by[3].refers_to == 1
    assert by[6].record_type == by[7].record_type == by[8].record_type == "response"
    lost = got[got.page_id.isna()].iloc[0]
    assert lost.record_type == "revisit" and lost.refers_to == 1
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None:
            assert (by[page].payload_bytes, by[page].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    uris = [r.archive for r in archives.collect()]
    heads = [open(u.removeprefix("file://"), "rb").read(12) for u in uris]
    assert any(struct.unpack("<I", h[:4])[0] == warc.DICTIONARY_FRAME and h[8:12] == warc.DICTIONARY_MAGIC for h in heads)
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_warc_trains_on_long_records_too(spark, tmp_path):
    page = "concat('<html>', array_join(transform(sequence(1, 10000), i -> concat('<li class=\"item\">', sha1(concat(id, '-', i)), '</li>')), ' '), '</html>')"
    pages = spark.range(64).selectExpr("id as page_id", "'u' as url", f"{page} as html")
    archives = warc.write_archives(pages, f"file://{tmp_path}/l")
    written = [(r.records, open(r.archive.removeprefix("file://"), "rb").read(4)) for r in archives.collect()]
    assert max(n for n, _ in written) >= 8
    assert all(struct.unpack("<I", head)[0] == warc.DICTIONARY_FRAME for n, head in written if n >= 8)
    assert warc.read_archives(archives).count() == 64


def test_archives_are_frames_that_others_can_read(tmp_path):
    records = [warc.record(i, "u", b"payload %d " % i * 30, len(b"payload %d " % i * 30), "d", None) for i in range(50)]
    archive = warc.Archive(f"file://{tmp_path}", "x.warc.zst", warc.train(records))
    for r in records:
        archive.add(r)
    assert list(warc.records(archive.close())) == records
    data = (tmp_path / "x.warc.zst").read_bytes()
    size = struct.unpack("<I", data[4:8])[0]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(data[8 + size :], read_across_frames=True)
    assert reader.read() == b"".join(records)


def test_tool_calls(spark):
    ddl = "conv_id long, call_id string, turn long, name string, arguments string, after string, extra int"
    calls = spark.createDataFrame([
        (1, "a", 2, "search", '{"query":"x","limit":2.0}', None, 1), (1, "b", 1, "search", '{"limit": 5, "query": "y"}', "a", 1),
        (1, "b", 3, "search", '{"query":"later"}', "a", 1), (1, "c", 1, "search", "{", "b", 1), (1, "d", 1, "search", '{"limit":5}', "gone", 1),
        (1, "e", 1, "none", "{}", None, 1), (1, "f", 1, "search", '{"query":"q"}', "g", 1), (1, "g", 1, "search", '{"query":"q"}', "f", 1),
        (1, "h", 1, "search", '{"query":"q"}', "f", 1), (None, "i", None, None, None, None, 1), (2, None, 1, "search", "{}", None, 1),
        (2, "j", 1, "search", '{"query":"a","query":"b"}', None, 1), (2, "k", 1, "search", '{"query":1e999}', None, 1),
    ], ddl)
    results = spark.createDataFrame([(1, x, 5, f"r{x}") for x in "abcdefgijk"] + [(1, "a", 4, "first"), (1, "zz", 1, None), (1, None, 1, "x")], "conv_id long, call_id string, turn long, content string")
    got = {r.call_id: r for r in tools.link_calls(calls, results).collect()}
    status = {k: r.status for k, r in got.items()}
    assert status == {"a": "ok", "b": "ok", "c": "bad_json", "d": "bad_arguments", "e": "unknown_tool", "f": "cycle", "g": "cycle",
                      "h": "no_result", "i": "unknown_tool", "j": "bad_json", "k": "bad_json", "zz": "no_call"}
    assert [got[x].depth for x in "abcdefh"] == [0, 1, 2, 0, 0, None, None]
    assert got["b"].n_calls == 2 and got["a"].n_results == 2
    assert got["b"].message == '{"call":{"after":"a","arguments":{"limit":5,"query":"y"},"id":"b","name":"search"},"conversation":1,"result":{"content":"rb","id":"b"}}'
    assert json.loads(got["a"].message)["result"]["content"] == "first"
    assert tools.link_calls(calls.limit(0), results.limit(0)).count() == 0


def test_turns_without_conversation_or_turn_are_kept_apart(spark):
    rows = [(None, 0, "user", "ask one"), (None, 0, "user", "ask two"), (None, 1, "assistant", "tell one"), (None, 1, "assistant", "tell two"),
            (None, 2, "user", "ask three"), (None, 2, "user", "ask three"), (0, None, "user", "ask four"), (0, None, "assistant", "tell four"),
            (1, None, "assistant", None), (1, None, "assistant", ""), (0, 0, "user", "ask five"), (0, 1, "assistant", "tell five")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = tools.link_calls(*tools.calls_and_results(turns)).collect()
    for _, _, _, text in rows:
        assert not text or sum(text in r.message for r in got) == 1
    assert sum(r.n_calls + r.n_results for r in got) == len(rows)
    linked = [r for r in got if r.n_calls and r.n_results]
    assert [(r.call_id, r.status) for r in linked] == [("call-0-0", "ok")] and "tell five" in linked[0].message
    assert all(r.depth in (0, None) for r in got) and len(got) == 10



def test_long_chains_of_calls(spark):
    rows = [(f"{i}", f"{i - 1}" if i else None) for i in range(75)]
    got = {r.call_id: r.depth for r in tools.depths(spark.createDataFrame(rows, "call_id string, after string")).collect()}
    assert got == {str(i): i for i in range(75)}


@pytest.mark.parametrize(("value", "bad"), [({"query": "x"}, 0), ({"query": ""}, 1), ({"query": 1}, 1), ({"query": "x", "limit": 101}, 1), ({"query": "x", "limit": True}, 1), ({"query": "x", "z": 1}, 1), ([], 1)])
def test_schemas(value, bad):
    assert len(tools.faults(value, tools.SCHEMAS["search"])) == bad


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 3
    x = (centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 16))).astype(np.float32)
    x[300:420] = x[300]  # a vector with many copies
    rows = [(int(i), [float(c) for c in v], "extra") for i, v in enumerate(x)]
    rows += [(1000, None, ""), (1100, [0.0] * 16, ""), (1200, [float("nan")] * 16, ""), (1300, [None] * 16, ""), (None, rows[5][1], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = neighbours.nearest_neighbours(df, F.col("vec_id") % 50 == 0).toPandas()
    asked = [i for i in range(0, 600, 50)]
    assert sorted(got["query_id"].unique()) == asked
    hits = 0
    for q in asked:
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(600), d))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        hits += len(set(best) & set(mine["vec_id"]))
        assert np.allclose(mine["score"], d[mine["vec_id"]]) and mine["score"].is_monotonic_increasing and len(mine) == 10
        if q in (300, 350, 400):
            assert mine["vec_id"].tolist() == best.tolist()
    assert hits >= 0.95 * 10 * len(asked)
    assert neighbours.nearest_neighbours(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = neighbours.nearest_neighbours(df.where("vec_id < 4"), F.col("vec_id") == 0)
    assert few.count() == 3


def test_flow_is_cheapest():
    flow = sharding.min_cost_flow([5, 0, 7], [4, 4, 4], [[0, 1, 1], [1, 0, 1], [1, 1, 0]])
    assert [sum(r) for r in flow] == [5, 0, 7] and [sum(c) for c in zip(*flow)] == [4, 4, 4]
    assert flow[0][0] == 4 and flow[2][2] == 4
    dear = sharding.min_cost_flow([3], [2, 2, 2], [[0, 5, 1]])
    assert dear == [[2, 0, 1]]
    with pytest.raises(ValueError):
        sharding.min_cost_flow([3], [1, 1], [[0, 1]])


def test_reshard(spark, edge_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = scratch_path(spark, "shards")
    got = sharding.reshard(docs, sharding.salt(24, "source"), folder).toPandas()
    text = docs.toPandas().set_index("doc_id")["text"]
    assert got["doc_id"].is_unique and set(got["doc_id"]) == set(text.index)
    for r in got.itertuples():
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sizes = got.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
    assert sizes.max() - sizes.min() <= got["size"].max()
    assert spark.read.parquet(folder).count() < len(got)  # only blocks that move are written
    edge = sharding.reshard(edge_docs, F.lit(0), scratch_path(spark, "shards")).toPandas()
    assert len(edge) == edge_docs.count()
    for _, g in edge.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert sharding.reshard(edge_docs.limit(0), F.lit(0), scratch_path(spark, "shards")).count() == 0
