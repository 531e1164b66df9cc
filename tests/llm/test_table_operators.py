"""Shards, token files, archives, top-k, near duplicates and the pipeline against plain versions."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from promptwatch.llm import jaccard as J
from promptwatch.llm import pivots as V
from promptwatch.llm import queries as Q
from promptwatch.llm import sharding as S
from promptwatch.llm import token_files as T
from promptwatch.llm import warc as A
from promptwatch.llm.shared import connected, folder

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables not present")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


# -- shards ----------------------------------------------------------------------------------------


def plain_shards(rows, limit):
    """Recursive splitting of (hash, bytes) rows: bits of each row's bucket, and the number of rows over the limit."""
    out = [None] * len(rows)

    def split(own, bits):
        if sum(rows[i][1] for i in own) <= limit or len(bits) == S.BITS:
            for i in own:
                out[i] = bits
            return
        for b in "01":
            split([i for i in own if (rows[i][0] >> (S.BITS - 1 - len(bits))) & 1 == int(b)], bits + b)

    split([i for i, r in enumerate(rows) if r[1] <= limit], "")
    return out


def test_shards_agree_with_recursive_splitting(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 60)) for i in range(300)] + [(None, 5), (7000, 5000)] + [(9000, 30)] * 40
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "k bigint, b int, cell string, shard string").repartition(4)
    out = S.shards(df, ["k"], F.col("b"), 100)
    assert out.columns == ["k", "b", "cell", "shard", "depth", "shard_bytes"]
    got = out.withColumn("h", S.hash_bits(F.col("k"))).collect()
    assert len(got) == len(rows)
    want = plain_shards([(r["h"], r["b"]) for r in got], 100)
    totals = {}
    for r in got:
        totals[r["shard"]] = totals.get(r["shard"], 0) + r["b"]
    for r, bits in zip(got, want):
        assert r["shard_bytes"] == totals[r["shard"]] and (r["shard_bytes"] <= 100 or r["k"] == 7000)
        if r["k"] == 9000:
            assert r["shard"].partition("+")[0] == bits and "+" in r["shard"]
        elif r["k"] != 7000:
            assert r["shard"] == bits and r["depth"] == len(bits)
    assert len({r["shard"] for r in got if r["k"] == 9000}) == 14  # three of 30 bytes to a page
    assert S.shards(df.limit(0), ["k"], F.col("b"), 100).collect() == []
    assert {r["shard"] for r in S.shards(df, ["k"], F.col("b"), 1 << 40).collect()} == {""}


# -- token files -------------------------------------------------------------------------------------


def test_token_files_hold_what_the_tokenizer_says(spark):
    from tokenizers import Tokenizer

    file = Q.tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    texts = [None, "", "Hello, world!\nIt's  fine", "\0 a\0b é中文😀 <|endoftext|> it'll", "word " * 30_000, "x" * 5000, "same", "same", " nbsp wide\x1cfs"]
    rows = [(7 * i % 11, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, "same")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, start int").repartition(3)
    path = T.write_tokens(docs, file, 2, folder(spark, "test"), parts=4)
    got = T.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    at = 0
    for (i, t), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), got, strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    names = os.listdir(path.removeprefix("file://").removeprefix("file:"))
    assert sum(os.path.getsize(os.path.join(path.removeprefix("file://").removeprefix("file:"), n)) for n in names if n.endswith(".ids")) == 2 * at
    assert T.token_ids(docs.limit(0), file).collect() == []


def test_tokenizers_that_keep_blanks_encode_whole_texts():
    words = T.Words(Q.tokenizer_file("byte_bpe_50k.json"))
    assert not words.by_word
    text = " two  blanks\nand a line"
    assert np.frombuffer(words.encode([text])[0], words.kind).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


# -- archives ------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)).map(sorted), min_size=1, max_size=9))
def test_loser_tree_merges_in_order_and_keeps_ties_by_run(runs):
    marked = [[(v, r, i) for i, v in enumerate(run)] for r, run in enumerate(runs)]
    assert list(A.LoserTree(marked)) == sorted(x for run in marked for x in run)


def test_archives_round_trip_and_merge_in_global_order(spark):
    html = [None, "", "<p>one</p>", "<p>one</p>", "é\r\n\r\nWARC/1.1" * 2000, "<p>one</p>", "ä"]
    rows = [(3 * i, f"http://WWW.b{i % 2}.example.com:80/p?q={i}", h) for i, h in enumerate(html)]
    rows += [(None, None, "<p>one</p>"), (None, "bad\nurl", "only"), (6, "http://b0.example.com/x", "<p>one</p>"), (40, "http://[", "ä")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    path = folder(spark, "test")
    merged = A.merge_runs(A.read_runs(spark, path, A.write_archives(pages, path))).orderBy("range", "position").collect()
    keys = [A._key(r.asDict()) for r in merged]
    assert keys == sorted(keys) and len(keys) == len(rows)
    keeper = {}
    for i, _, h in rows:
        if i is not None:
            keeper[h or ""] = max(keeper.get(h or "", -1), i)
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        refers = keeper.get(h or "") if keeper.get(h or "") != i else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in A.captures(pages).collect()), key=order) == sorted(want, key=order)
    assert A.captures(pages.limit(0)).collect() == []
    assert {r["record_type"] for r in A.captures(pages, least=10**9).collect()} == {"response"}


# -- top-k -------------------------------------------------------------------------------------------------


def plain_top(rows, k):
    v = [(i, n, [int(np.floor(256.0 * x)) for x in e]) for n, (i, e) in enumerate(rows) if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, n, e in v:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(e, f)), j) for j, m, f in v if m != n)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_with_ties_odd_vectors_and_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 6))
    rows = [(i, (centres[i % 5] + rng.normal(scale=0.2, size=6)).tolist()) for i in range(260)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(300, None), (350, [1.0, None]), (400, [float("nan")] * 6), (450, [float("inf")] * 6)]
    rows += [(500, [1.0, 2.0]), (550, []), (None, [1.0] * 6), (100, rows[100][1]), (50, [9.0] * 6), (600, [0.0] * 6)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, ring int, uid int").repartition(3)
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 4)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in V.top_products(df).collect())
    assert got == plain_top(rows, 5)
    assert V.top_products(df.limit(0)).collect() == [] and V.top_products(df.where("vec_id = 150")).collect() == []


@pytest.mark.parametrize("scale", [1e3, 3e8, 1e12])
def test_top_k_of_large_components(spark, scale):
    """Products beyond the doubles' exact range, near the end of 64 bits, and beyond it."""
    rng = np.random.default_rng(8)
    rows = [(i, (scale * rng.normal(size=3)).tolist()) for i in range(120)] + [(500, [1e300, 0.0, 0.0])] * (scale == 1e12)
    top = 2**63 - 1
    floor = lambda x: max(-top - 1, min(top, int(np.floor(256.0 * x))) if abs(x) < 1e200 else top)
    v = {i: [floor(x) for x in e] for i, e in rows}
    want = []
    for i in (i for i in v if i % 50 == 0):
        best = sorted((-max(-top - 1, min(top, sum(a * b for a, b in zip(v[i], v[j])))), j) for j in v if j != i)[:5]
        want += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in V.top_products(df).collect()) == sorted(want)


def test_the_index_prunes_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "RING_ROWS", 64)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, (centres[i % 40] + rng.normal(scale=0.02, size=16)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = V.nearest(df, F.col("id") % 50 == 0, counted=True).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == plain_top(rows, 5)
    share = np.mean([r["compared"] for r in got]) / len(rows)
    assert share < 0.3
    # what is not asked of the clusters is asked of the distances: one far direction has its own answer
    assert len({r["query_id"] for r in got}) == 80


def test_bounds_are_never_below_the_score():
    rng = np.random.default_rng(5)
    x, q = rng.integers(-300, 300, (400, 8)), rng.integers(-300, 300, (20, 8))
    longest = float(np.linalg.norm(x, axis=1).max())
    lifted, asked = V.with_added(x, longest, False), V.with_added(q, longest, True)
    far = ((asked[:, None] - lifted[None]) ** 2).sum(axis=2)
    squared = (q * q).sum(axis=1).astype(float)
    assert np.allclose(far, squared[:, None] + longest**2 - 2 * q @ x.T)  # products are distances
    pivots = V.choose_pivots(lifted[:50], 4)
    gaps, one = V.distances(lifted, pivots), np.ones(len(x), int)
    index = V.Index(pivots, longest, np.arange(len(x)), gaps, gaps, one, 0 * one, one)  # every row a ring of its own
    assert (V.bounds(V.distances(asked, pivots), squared, index) >= q @ x.T).all()


# -- near duplicates --------------------------------------------------------------------------------------


def plain_components(rows, words, over, of):
    """(size, component) of each (doc_id, text) row."""
    sets = {}
    for i, t in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if x]
        sets.setdefault(i, set()).update({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and of * len(x & y) >= over * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def families(rng, groups, size, vocabulary):
    """Texts in families: a base, exact copies, and copies with some words changed; some share a long passage."""
    passage = [f"p{i}" for i in range(60)]
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([1, 2, 8, 40, 120]))]
        if g % 3 == 0:
            base = base + passage
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("crowded, over, words", [(24, 90, 3), (2, 80, 5), (1, 90, 3)])
def test_components_agree_with_all_pairs(spark, monkeypatch, crowded, over, words):
    monkeypatch.setattr(J, "CROWDED", crowded)
    monkeypatch.setattr(J, "BLOCK_ROWS", 7)
    rng = random.Random(crowded)
    texts = [None, "", " \t", "A b", "a  B", "one", "ONE\n"] + families(rng, 30, 12, 5000)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(i, t) for i, t in rows[-40:]] + [(9999, rows[-1][1])]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id bigint, text string, size int, token string").repartition(4)
    got = {}
    for r in J.near_duplicates(df, words, over, 100).collect():
        assert got.setdefault(r["doc_id"], (r["n_shingles"], r["component_id"])) == (r["n_shingles"], r["component_id"])
    assert got == plain_components(rows, words, over, 100)


def test_different_texts_that_share_an_id(spark):
    def text(k, changed=""):
        return " ".join(f"w{k}x{i}" for i in range(60)) + changed

    rows = [(5, text(0)), (5, text(1)), (7, text(0, " more")), (8, text(1, " more")), (3, text(2)), (5, text(2)), (9, text(3)), (9, text(3, " more")), (10, text(4))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["component_id"]) for r in J.near_duplicates(docs).collect()}
    assert got == {(5, 3), (7, 3), (8, 3), (3, 3), (9, 9), (10, 10)}
    kept = sorted(tuple(r) for r in J.one_of_each(docs).collect())
    assert [k for k in kept if k[0] != 9] == sorted([rows[0], rows[1], rows[4], rows[8]])
    assert sum(k[0] == 9 for k in kept) == 1


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id bigint, text string"
    assert J.linked_documents(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d"), (None, None), (4, "a b c d"), (2, "x y z " * 50_000)]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in J.linked_documents(spark.createDataFrame(rows, schema)).collect())
    assert got == [("2", 3, 2), ("4", 2, 4), ("None", 0, None), ("None", 2, 4)]
    docs = spark.createDataFrame([(5, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 2), (7, None, 3), (8, "", 4), (None, "q", 5), (None, "q", 6)], "doc_id bigint, text string, component_id int")
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["component_id"] for r in kept.collect()) == [2, 3, 4, 5, 6]


def test_signature_tree_pairs_cover_all_similar_pairs():
    rng = random.Random(9)
    universe = [rng.getrandbits(64) for _ in range(4000)]
    sets = []
    for _ in range(60):
        base = set(rng.sample(universe, rng.randint(5, 200)))
        for _ in range(rng.randint(1, 5)):
            own = set(base)
            for x in rng.sample(sorted(own), min(len(own) - 1, rng.randint(0, 8))):
                own.discard(x)
            sets.append(own)
    trees = {}
    for w in sorted({J.width_of(len(s)) for s in sets}):
        at = [i for i, s in enumerate(sets) if J.width_of(len(s)) == w]
        bits = np.zeros((len(at), w), bool)
        for k, i in enumerate(at):
            bits[k, [x & (w - 1) for x in sets[i]]] = True
        trees[w] = np.array(at), J.SignatureTree(np.packbits(bits, axis=1).view(np.uint64), np.array([len(sets[i]) for i in at]))
    found = set()
    for w, (at, tree) in trees.items():
        i, j = J.dual_pairs(tree, tree, 80, 100)
        found |= {frozenset(p) for p in zip(at[i].tolist(), at[j].tolist())}
        if 2 * w in trees:
            more, wide = trees[2 * w]
            i, j = J.dual_pairs(tree, wide.fold(), 80, 100)
            found |= {frozenset(p) for p in zip(at[i].tolist(), more[j].tolist())}
    similar = {frozenset((a, b)) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert similar and similar <= found and len(found) < len(sets) * len(sets) / 8


def test_connected_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 140)] + [(139, 200), (5, 5), (301, 300), (300, 301)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {200: 100, 300: 300, 301: 300}
    assert got == want
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# -- queries and the pipeline --------------------------------------------------------------------------


@needs_data
@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry_module.queries()[name](spark, DATA)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({entry_module.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(want, key=key)


@needs_data
def test_pipeline_stages(spark, tmp_path):
    from tests.llm.test_text_operators import plain_hits, plain_spans

    raw = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("node", F.lit(1))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    docs, seen = raw, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == raw.columns + ["piece_ids"] * (name == "pieces")
    before = {r["doc_id"]: r["text"] for r in raw.collect()}
    kept = seen["language"]
    assert len(kept) > 0.98 * len(before) and all(r["text"] == before[i] for i, r in kept.items())
    components = plain_components([(i, r["text"]) for i, r in kept.items()], 5, 80, 100)
    assert set(seen["near_duplicates"]) == {i for i, (n, c) in components.items() if i == c}
    for i, r in seen["decontamination"].items():
        assert not plain_hits(r["text"], items)[1] and r["n_chars"] == len(r["text"])
        if not plain_hits(before[i], items)[1]:
            assert r["text"] == before[i]
    for i, r in seen["personal_data"].items():
        assert not plain_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not plain_spans(seen["decontamination"][i]["text"]):
            assert r["text"] == seen["decontamination"][i]["text"]
    for i, r in seen["pieces"].items():
        assert r["text"] == seen["personal_data"][i]["text"] and len(r["piece_ids"]) > 0
