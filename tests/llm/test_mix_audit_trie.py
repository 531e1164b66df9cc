"""Source mixing, the divergence audit and the conversation trie against plain versions."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptwatch.llm import divergence as D
from promptwatch.llm import mixing as M
from promptwatch.llm import trie as C
from promptwatch.llm.shared import materialize

# -- mixing ------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Share, cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        rest = budget - sum(epochs * sizes[s] for s in capped)
        part = {s: Fraction(rest * weight[s], sum(weight[t] for t in open_)) for s in open_}
        above = {s for s in open_ if part[s] >= epochs * sizes[s]}
        if not above:
            return {s: Fraction(epochs * sizes[s]) if s in capped else part[s] for s in names}
        capped |= above


def mixed_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, target string")


def test_mix_meets_its_targets(spark):
    rng = random.Random(4)
    texts = lambda n: [" ".join("w" for _ in range(rng.randint(0, 40))) for _ in range(n)]
    rows = [(i, t, s) for i, (s, t) in enumerate((s, t) for s, n in (("a", 30), ("b", 200), ("é", 9), ("c", 3), (None, 25), ("", 40)) for t in texts(n))]
    rows += [(None, "x y z", "a"), (None, None, "b"), (5, "", "z"), (1000, "v " * 3000, "c"), (1000, "v " * 3000, "c"), (7, "p q\tr", "a")]
    df = mixed_rows(spark, [(*r, 1, "t") for r in rows])
    got = M.mixed_words(df.repartition(5)).collect()
    assert len(got) == len(rows)
    count = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    targets = plain_targets(sizes)
    by_key = {}
    for i, t, s in rows:
        by_key.setdefault((i, count(t), sizes[s], float(targets[s])), []).append(s)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        key = (r["doc_id"], r["size"], r["source_size"], r["target"])
        taken[by_key[key].pop()] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["mix_at"] is None) == (r["taken"] == 0)
    assert not any(by_key.values())
    assert sum(taken.values()) == sum(sizes.values())
    assert all(abs(taken[s] - targets[s]) <= len(sizes) for s in sizes)
    again = M.mixed_words(df.repartition(3, "text")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_itself_is_in_order_of_virtual_finish(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(120)] + [(500, "w " * 90, "s1")]
    df = mixed_rows(spark, [(*r, i, "t") for i, r in enumerate(rows)]).withColumn("mix_at", F.lit("old"))
    out = M.mixture(df, weights=(3, 1), epochs=2, share=0.5)
    assert out.columns == ["doc_id", "text", "source", "size", "target", "mix_copy", "mix_words", "mix_at"]
    mix = sorted(out.collect(), key=lambda r: r["mix_at"])
    assert [r["mix_at"] for r in mix] == np.cumsum([0, *[r["mix_words"] for r in mix[:-1]]]).tolist()
    total = sum(len(r[1].split()) for r in rows)
    assert sum(r["mix_words"] for r in mix) == total // 2
    whole = [r for r in mix if r["mix_words"] == len(r["text"].split())]
    assert len(mix) - len(whole) <= 4  # those in service at the end
    served, finish = {}, []
    for r in whole:
        served[r["source"]] = served.get(r["source"], 0) + r["mix_words"]
        finish.append(served[r["source"]] / {"s0": 3, "s1": 1, "s2": 3, "s3": 1}[r["source"]])
    assert finish == sorted(finish)
    seen = {}
    for r in mix:  # a document's second copy comes after its source's whole first round
        assert r["mix_copy"] == seen.get(r["size"], -1) + 1
        seen[r["size"]] = r["mix_copy"]


def test_mix_of_nothing(spark):
    assert M.mixed_words(mixed_rows(spark, [])).collect() == []
    got = M.mixed_words(mixed_rows(spark, [(1, None, "a", 1, ""), (2, " ", None, 1, "")])).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"], r["mix_at"]) for r in got) == [(1, 0, 0, 0.0, 0, None), (2, 0, 0, 0.0, 0, None)]
    only = M.mixed_words(mixed_rows(spark, [(1, "a b", "x", 1, "")])).collect()
    assert [(r["target"], r["taken"], r["mix_at"]) for r in only] == [(2.0, 2, 0)]


def test_running_sums_over_ranges(spark):
    rows = [(random.Random(i).randrange(50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = sorted(tuple(r) for r in M.running(df, [F.col("k"), F.col("v")], {"before": "v"}).collect())
    total, want = 0, []
    for k, v in sorted(rows):
        want.append((k, v, total))
        total += v
    assert got == want


# -- divergence --------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
ASCII = {i: i + 32 for i in range(65, 91)}


def plain_audit(rows, least=10, top=10):
    groups, docs = {}, {}
    for text, lang, source in rows:
        lang, words = lang or "", [w.translate(ASCII) for w in TERM.findall(text or "")]
        own = groups.setdefault((lang, source or ""), {})
        for w in words:
            own[w] = own.get(w, 0) + 1
        for w in set(words):
            docs[lang, w] = docs.get((lang, w), 0) + 1
    out = []
    for lang in {g for g, _ in groups}:
        kept = [w for (g, w), n in docs.items() if g == lang and n >= least]
        own = {s: c for (g, s), c in groups.items() if g == lang}
        share = lambda c, n, k=len(kept): 1 + 10**9 * (c + 2) // (n + 2 * k)
        total = {s: sum(c.get(w, 0) for w in kept) for s, c in own.items()}
        p = {s: {w: share(c.get(w, 0), total[s]) for w in kept} for s, c in own.items()}
        q = {w: share(sum(c.get(w, 0) for c in own.values()), sum(total.values())) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in own if o != s]
            terms = [(f(p[s][w], q[w]), w) for w in kept if own[s].get(w) and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def audit_rows(rng, n):
    vocabulary = ["The", "the", "Öl", "öl", "don't", "naïve", "日本", "a1b2", "x_y"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "", None, "ß"])
        words = [rng.choice(vocabulary[: rng.choice([9, 40, 99])]) for _ in range(rng.randint(0, 30))]
        rows.append((" ".join(words), lang, source))
    return rows + [(None, "en", "s1"), ("", "xx", "only"), ("alone once", "yy", "a"), (None, "yy", "b"), ("the " * 4000, "en", "s9")] + [rows[0]] * 12


def audit_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, digest int, gid string")


@pytest.mark.parametrize("bits, terms, groups, least", [(64, 1024, 128, 10), (5, 8, 2, 3), (12, 4, 1, 1)])
def test_audit_agrees_with_a_plain_one(spark, monkeypatch, bits, terms, groups, least):
    monkeypatch.setattr(D, "BLOCK_TERMS", terms)
    monkeypatch.setattr(D, "BLOCK_GROUPS", groups)
    monkeypatch.setattr(D, "HELD_ROWS", 40 if bits < 64 else 1 << 20)
    monkeypatch.setattr(D, "PIECE_BYTES", 300 if bits < 64 else 4 << 20)
    rows = audit_rows(random.Random(bits), 220)
    got = D.source_divergence(audit_table(spark, rows).repartition(3), least, 10, bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, least)


def test_audit_of_odd_tables(spark):
    assert D.audit(audit_table(spark, [])).collect() == []
    rows = [("a b", "en", "x"), ("a", "en", "y"), (None, None, None)]  # no term in ten documents
    got = sorted(tuple(r) for r in D.audit(audit_table(spark, rows)).collect())
    assert got == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_strings_behind_a_digest_are_told_apart():
    words = D._Words(["bb aa a", "aa cc aa"], 64)
    words.digest = np.zeros(len(words.digest), np.int64)
    assert [x.to_pylist() for x in words.ends(np.array([0]))] == [[b"a"], [b"cc"]]
    words = D._Words(["aa AA aA"], 64)
    assert [x.to_pylist() for x in words.ends(np.array([0]))] == [[b"aa"], [b"aa"]]


# -- the trie ----------------------------------------------------------------------------------------


def plain_trie(convs):
    """Rows of every prefix of {conv_id: sequence of (role, text)}."""
    prefixes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            prefixes.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for path, members in prefixes.items():
        below = [p for p in prefixes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(o) == len(p) + 1 and o[: len(p)] == p for o in below)]
        saved = sum((len(prefixes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(path))
        parent = min(prefixes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain_rebuilt(turns):
    own = {}
    for c, turn, role, text in sorted((t for t in turns if t[0] is not None), key=lambda t: (t[0], t[1] is not None, t[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - int(np.fmod(c, 5)), [])
        out[c] = base[:h] + seq[h:]
    return out


def conversation_rows(rng, n):
    turns = []
    for c in [*range(n), -7, -5, 10**12, 10**12 + 3]:
        if c % 11 == 10:
            continue
        length = rng.choice([0, 1, 2, 3, 5, 8, 12])
        for t in range(length):
            turn = None if t == 0 and c % 4 == 0 else t
            turns.append((c, turn, rng.choice(["user", "bot", None]) if c % 3 == 0 else "user", rng.choice(["", None, "hé", "ok", "no"])))
    return turns + [(None, 1, "user", "lost"), (3000, 0, "user", "long " * 50_000), (3001, 0, "user", "long " * 50_000)]


SCHEMA = "conv_id bigint, turn bigint, role string, text string, place int, path string"


@pytest.mark.parametrize("batch, pack", [(10_000, 16), (3, 2), (1, 0)])
def test_trie_agrees_with_a_plain_one(spark, monkeypatch, batch, pack):
    monkeypatch.setattr(C, "PACK", pack)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        turns = conversation_rows(random.Random(batch), 140)
        df = spark.createDataFrame([(*t, 1, "p") for t in turns], SCHEMA).repartition(4)
        got = sorted((tuple(r) for r in C.conversation_trie(df).collect()), key=str)
        assert got == plain_trie(plain_rebuilt(turns))
        assert C.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_turns_with_equal_numbers_have_an_order_of_their_own(spark):
    rows = [(1, 0, "u", "a", 1, ""), (1, 0, "u", "b", 1, ""), (2, 0, "u", "b", 1, ""), (2, 0, "u", "a", 1, "")]
    seqs = C.sequences(C.turns_in_order(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    assert len({str(r["seq"]) for r in seqs}) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=6).map(tuple), min_size=1, max_size=25, unique=True), st.data())
def test_a_piece_has_every_node_once(seqs, data):
    seqs = sorted(seqs)
    n = np.array([data.draw(st.integers(1, 4)) for _ in seqs], np.int64)
    least = np.arange(100, 100 + len(seqs))
    turns = [np.array([[t, 0, 1] for t in s], np.int64).reshape(-1, 3) for s in seqs]
    table = C.piece_forest(turns, least, n)
    want = {s[:d] for s in seqs for d in range(len(s) + 1)}
    rows = table.to_pylist()
    assert len(rows) == len(want)
    assert sorted((r["depth"], r["least"], r["n"]) for r in rows) == sorted(
        (len(w), min(x for s, x in zip(seqs, least.tolist()) if s[: len(w)] == w), sum(x for s, x in zip(seqs, n.tolist()) if s[: len(w)] == w)) for w in want
    )
    ends = [seqs[0], seqs[-1]]
    assert sum(r["path"] is not None for r in rows) == len({s[:d] for s in ends for d in range(len(s) + 1)})


def test_long_lists_of_members_are_hashed_in_order(spark):
    convs = spark.createDataFrame([(i * 37, [(1, 2, 3)]) for i in range(-50, 400)], "conv_id bigint, seq array<struct<h1: bigint, h2: bigint, bytes: bigint>>")
    _, ends = C._classes(materialize(convs))
    got = {r["ended"]: r["ends_sha256"] for r in ends.collect()}
    assert got == {-1850: hashlib.sha256(",".join(str(i * 37) for i in range(-50, 400)).encode()).hexdigest()}



def test_counts_leave_a_task_in_small_batches():
    many = D.BATCH_ROWS + 5
    words = " ".join("w" + chr(97 + i % 26) + "".join(chr(97 + int(c)) for c in str(i)) for i in range(many))
    batch = pa.record_batch([pa.array([words, "one"]), pa.array(["x", "x"]), pa.array(["s", "t"])], names=["text", "lang", "source"])
    out = list(D._counted(64, False)(iter([batch])))
    assert max(b.num_rows for b in out) <= D.BATCH_ROWS
    rows = pa.Table.from_batches(out).to_pylist()
    assert sorted((r["lang"], r["source"], r["n"]) for r in rows if r["n"] is not None) == [("x", "s", 1)] * many + [("x", "t", 1)]
    assert sum(r["low"] is not None for r in rows) == many + 1
