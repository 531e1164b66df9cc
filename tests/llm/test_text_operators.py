"""Language, personal data, decontamination, pieces and licences against plain versions."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptwatch.llm import decontaminate as D
from promptwatch.llm import language as L
from promptwatch.llm import licenses as C
from promptwatch.llm import pii as P
from promptwatch.llm import queries as Q
from promptwatch.llm import unigram as U

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables not present")
ODD = "doc_id bigint, text string, lang string, language string, pii string, pieces string, contamination string"
LONG = "the quick brown fox " * 20_000


def odd_documents(spark):
    """Nulls, empty, wordless and very long texts, repeated rows, clashing columns."""
    texts = [None, "", " \n\t", "12 34 !!", LONG, "the quick brown fox", "the quick brown fox", "x" * 100_000]
    rows = [(i, t, "en", "a", "b", "c", "d") for i, t in enumerate(texts)]
    rows += [(None, "der schnelle braune fuchs", None, None, None, None, None), (5, "the quick brown fox", "en", "a", "b", "c", "d")]
    return spark.createDataFrame(rows, ODD)


# -- languages ---------------------------------------------------------------------------------


def slow_shares(like, rounds=400):
    """EM one word at a time."""
    w = np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(rounds):
        total = np.zeros(len(w))
        for row in like:
            r = w * np.exp(row - row.max())
            total += r / r.sum()
        w = total / len(like)
    return w


def test_shares_agree_with_a_plain_loop_whatever_the_batch():
    rng = np.random.default_rng(1)
    docs = [rng.normal(0, 3, (n, 3)) for n in (1, 5, 40, 200)]
    shares = L.estimate(np.concatenate(docs), np.array([len(d) for d in docs]), rounds=2000, near=1e-9)[0]
    for got, like in zip(shares, docs):
        assert np.abs(got - slow_shares(like)).max() < 0.01
    alone = [L.estimate(d, np.array([len(d)]))[0][0] for d in docs]
    together = L.estimate(np.concatenate(docs), np.array([len(d) for d in docs]))[0]
    assert np.allclose(alone, together, atol=1e-12)


def test_the_bound_holds_wherever_em_stops():
    rng = np.random.default_rng(7)
    for n in (3, 50, 2000):
        like = rng.normal(0, 2, (n, 4))
        best = L.estimate(like, np.array([n]), rounds=5000, near=1e-6)[1][0]
        for rounds in (1, 2, 5, 20):
            _, value, bound = L.estimate(like, np.array([n]), rounds=rounds)
            assert value[0] <= best + 1e-6 and best <= bound[0] + 1e-6
    settled = L.estimate(like, np.array([n]), enough=np.array([1e9]))
    assert settled[2][0] >= best  # it may stop at once, but never below the best


def test_a_small_language_in_a_long_text_is_found():
    words = [["albero", "casa", "fiume"], ["wolke", "strasse", "baum"], ["träd", "hus", "flod"]]
    counts = [np.unique(L._trigrams([" ".join(own) * 50])[0], return_counts=True) for own in words]
    model = L.LanguageModel(["it", "de", "sv"], counts)
    text = " ".join(words[0] * 4000 + words[2] * 4)
    at, share = L.mixtures([text], model.tables, 2.0)[0]
    assert at.tolist() == [0, 2] and abs(share[1] - 12 / 12012) < 2e-4


def test_any_number_of_labels(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for k in range(600):  # more labels than were allowed once; each has an alphabet of its own
        letters = [chr(0x4E00 + 20 * k + i) for i in range(20)]
        rows += [(4 * k + i, "".join(rng.choice(letters) for _ in range(60)), f"l{k:03}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    got = L.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 2400 and all(r["lang_pred"] == r["lang"] for r in got if not r["held_out"])  # the others' trigrams are new
    few = docs.where("doc_id < 40")
    dense = sorted(str(r) for r in L.languages(few).collect())
    monkeypatch.setattr(L, "DENSE_LANGUAGES", 2)
    assert sorted(str(r) for r in L.languages(few).collect()) == dense


@needs_data
def test_rows_of_no_known_language_go(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    by = {r["lang"]: r["t"] for r in docs.where("length(text) > 800").groupBy("lang").agg(F.max_by("text", "doc_id").alias("t")).collect()}
    noise = "qzxv wkjq xxvz pqwk zzkq jjxq vwqz kqxj"
    odd = [
        (10_001, noise), (10_002, noise * 300), (10_003, "To jest zdanie po polsku, które opowiada o historii domu i o tym, jak został zbudowany."),
        (10_004, "это предложение на русском языке о доме"), (10_005, "12 34"), (10_006, None),
        (10_009, by["fr"][:60] + ' token = "6cfd1f1f244d4c4c327ecfd8fd9898497c475388"'), (10_007, by["en"][:300] + " " + noise), (10_008, by["en"][:400] + by["de"][:400] + by["fr"][:400] + by["es"][:400]),
    ]
    every = docs.unionByName(spark.createDataFrame([(i, t, None) for i, t in odd], "doc_id bigint, text string, lang string"))
    left = {r["doc_id"] for r in every.join(L.keep_identified(every).select("doc_id").distinct(), "doc_id", "left_anti").collect()}
    assert left == {10_001, 10_002, 10_003, 10_004, 10_005, 10_006}


@needs_data
def test_languages_held_out_and_mixed(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = L.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.95 and got.score.between(0, 1).all()
    by = {r["lang"]: r["t"] for r in docs.where("length(text) > 800").groupBy("lang").agg(F.max_by("text", "doc_id").alias("t")).collect()}
    mixed = spark.createDataFrame([(by["en"][:800] + "\n" + by["de"][:800],)], "text string")
    row = L.identify(mixed, L.train(docs)).first()["language"]
    assert sorted(row["languages"][:2]) == ["de", "en"] and min(row["shares"][:2]) > 0.2


def test_languages_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = L.languages(docs).orderBy("doc_id", "lang_pred").collect()
    assert len(got) == docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (0, 1, 2, 3))
    assert {r["lang_pred"] for r in got if r["doc_id"] == 5} == {"en"}
    assert L.languages(docs.limit(0)).collect() == []
    assert {r["lang_pred"] for r in L.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6}  # one is in a language that no row teaches, one is a single letter 100,000 times


# -- personal data ------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0

    return (
        [("email", *m.span()) for m in EMAIL.finditer(text)]
        + [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        + [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    )


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ 1239(é%", max_size=60))
def test_base_spans_agree_with_the_patterns(text):
    assert P.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_texts_take_linear_time():
    text = "a" * 300_000 + "@" + "1" * 300_000 + " a@b.co +" + "1 " * 50_000
    assert ("email", 600_002, 600_008) in P.base_spans(text)


def test_votes_and_reliabilities_find_the_good_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    v = np.zeros((4000, P.VOTERS), int)
    for j, right in enumerate((0.95, 0.9, 0.85, 0.6, 0.55, 0.5)):
        v[:, j] = np.where(rng.random(4000) < right, np.where(truth, 1, -1), np.where(truth, -1, 1))
    p, prior, table = P.reliabilities(v, np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.93 and abs(prior - 0.4) < 0.05
    right = table[1, :, 2]
    assert right[0] > right[3] > right[5] - 0.05
    x = P._unpack(np.arange(0, 3**6 * 16, 7))[1]
    soft = 1 / (1 + np.exp(-(x @ np.linspace(-1, 1, x.shape[1]))))
    w = P.regression(x, soft, np.ones(len(x)), ridge=1e-6)
    assert np.abs(1 / (1 + np.exp(-(x @ w))) - soft).max() < 1e-3


def test_personal_data_adds_spans_and_keeps_base(spark):
    lines = [(i, f"please call my phone (207) 555-{1000 + i} or write me{i}@host.example.com now") for i in range(60)]
    lines += [(100 + i, f"serial number token 207-555-{1000 + i}x9") for i in range(20)] + [(200, None), (201, "")]
    docs = spark.createDataFrame([(*x, "c") for x in lines], "doc_id bigint, text string, pii string")
    got = {r["doc_id"]: r for r in P.personal_data(docs).collect()}
    for i, text in lines:
        base = plain_spans(text or "")
        joined = ",".join("%s:%d:%d" % s for s in base)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(got[i]["spans"].split(","))
        assert [got[i][f"n_{k}"] for k in P.KINDS] == [sum(s[0] == k for s in base) for k in P.KINDS]
    assert all("phone:" in got[i]["spans"] for i in range(60))
    assert got[200]["spans"] == got[201]["spans"] == "" and got[105]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in P.without_personal_data(docs).collect()}
    assert clean[3] == "please call my phone [PHONE] or write [EMAIL] now" and clean[200] is None and clean[201] == ""
    assert P.personal_data(docs.limit(0)).collect() == []


# -- decontamination ------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(text, items, window=10):
    w, hit, found = words_of(text), set(), set()
    for name, item in items:
        v = words_of(item)
        n = min(window, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(str(name))
    return len(w), hit, found


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from("ab Cé!"), max_size=60).map("".join), max_size=6),
    st.lists(st.lists(st.sampled_from("ab cÉ"), max_size=40).map("".join), max_size=4), st.integers(1, 4),
)
def test_fm_index_agrees_with_plain_search(texts, items, window):
    named = list(enumerate(items))
    found = D.scan([t.encode() for t in texts], D.Phrases([(str(i), t) for i, t in named], window))
    for text, (n, spans, names, hits) in zip(texts, found):
        want_n, hit, want_names = plain_hits(text, named, window)
        assert (n, hits, set(names)) == (want_n, len(hit), want_names)
        cut = b"".join([text.encode()[a:b] for (_, a), (b, _) in zip([(0, 0), *spans], [*spans, (len(text.encode()), 0)])])
        assert len(words_of(cut.decode())) <= n - len(hit) + 1 or hit == set()


def test_contamination_of_odd_rows_and_blocks(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog again and again until noon"
    items = spark.createDataFrame([(1, item), (2, None), (3, "  "), (4, "braune fuchs"), (None, "quick brown"), (1, item)], "item_id bigint, text string")
    docs = odd_documents(spark).unionByName(spark.createDataFrame(
        [(50, f"Before. {item.upper()}! After, the quick brown.", "en", "", "", "", "")], ODD))
    known = [(r["item_id"], r["text"]) for r in items.collect()]

    def check():
        for r in D.contaminated(docs, items).join(docs.select("doc_id", "text"), "doc_id").collect():
            n, hit, found = plain_hits(r["text"], known)
            ids = ",".join(sorted(found - {"None"}))
            assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, len(hit), len(found - {"None"}))
            assert r["items_sha256"] == hashlib.sha256(ids.encode()).hexdigest() and r["contaminated"] == bool(hit)

    check()
    monkeypatch.setattr(D, "BLOCK_BYTES", 64)
    check()
    cleaned = {r["doc_id"]: r["text"] for r in D.without_benchmark(docs, items).collect()}
    assert cleaned[50] == "Before. ! After, the ." and cleaned[0] is None and cleaned[3] == "12 34 !!"
    assert D.without_benchmark(docs, items.limit(0)).columns == docs.columns
    assert not any(r["contaminated"] for r in D.contaminated(docs, items.limit(0)).collect())


# -- pieces ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return U.Pieces(Q.tokenizer_file("piece_bpe_32k.model"))


def test_double_array_finds_every_key_and_no_other():
    rng = random.Random(3)
    keys = sorted({bytes(rng.choices(b"ab\xc3\xff", k=rng.randint(1, 6))) for _ in range(300)})
    trie = U.DoubleArray(keys, list(range(len(keys))))

    def look(key):
        s = 0
        for b in key:
            t, ok = trie.child(np.array([s]), np.array([b]))
            if not ok[0]:
                return -1
            s = int(t[0])
        return int(trie.value[s])

    assert [look(k) for k in keys] == list(range(len(keys)))
    others = {bytes(rng.choices(b"ab\xc3\xffz", k=rng.randint(1, 7))) for _ in range(500)} - set(keys)
    assert all(look(k) == -1 for k in others)


def fields(data):
    """Top-level fields of a protocol message: (number, wire type, raw value with its length, value)."""
    def number(at):
        value = shift = 0
        while True:
            b = data[at]
            value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 2:
            n, at = number(at)
            yield key >> 3, 2, data[at : at + n]
            at += n
        elif key & 7 == 5:
            yield key >> 3, 5, data[at : at + 4]
            at += 4
        else:
            value, at = number(at)
            yield key >> 3, 0, value


def packed(items):
    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = []
    for field, kind, value in items:
        out.append(number(field << 3 | kind) + (number(len(value)) + value if kind == 2 else value if kind == 5 else number(value)))
    return b"".join(out)


def test_pieces_agree_with_the_library_on_the_same_unigram_model(model):
    import struct

    from sentencepiece import SentencePieceProcessor

    raw = open(Q.tokenizer_file("piece_bpe_32k.model"), "rb").read()
    out, k = [], 0
    for field, kind, value in fields(raw):
        if field == 1:
            own = [(f, t, struct.pack("<f", model.score[k]) if f == 2 else v) for f, t, v in fields(value)]
            value, k = packed(own), k + 1
        elif field == 2:
            value = packed([(f, t, 1 if f == 3 else v) for f, t, v in fields(value)])
        out.append((field, kind, value))
    library = SentencePieceProcessor(model_proto=packed(out))
    texts = ["Hello world", "  two  blanks ", "a\nb\n\n c", "é中文😀 mixed\ttab", "longwordwithoutanyblanks" * 9 + " end", "", "unseen𐍈char", "The quick brown fox."]
    for text, data in zip(texts, model.encode(texts)):
        ids = np.frombuffer(data, "<i4")
        assert ids.tolist() == library.encode(text), text
        assert model.decode(ids) == library.decode(ids.tolist()) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80).filter(lambda t: U.MARK not in t and not any("\ud800" <= c <= "\udfff" for c in t)))
def test_pieces_round_trip_and_cuts_lose_nothing(text):
    model = test_pieces_round_trip_and_cuts_lose_nothing.model
    ids = np.frombuffer(model.encode([text])[0], "<i4")
    assert model.decode(ids) == text
    if text:
        whole = model.viterbi((U.MARK + text.replace(" ", U.MARK)).encode())
        cost = lambda x: sum(model.score[i] if not model.byte[i] else 0 for i in x)
        assert cost(ids) == pytest.approx(cost(whole)) and len(ids) == len(whole)


@pytest.fixture(autouse=True, scope="module")
def _model_for_hypothesis(model):
    test_pieces_round_trip_and_cuts_lose_nothing.model = model


def test_pieces_of_odd_rows(spark):
    docs = odd_documents(spark)
    file = Q.tokenizer_file("piece_bpe_32k.model")
    got = U.digests(docs, file).collect()
    assert len(got) == docs.count() and all(r["round_trip"] for r in got)
    assert {r["n_pieces"] for r in got if r["doc_id"] in (0, 1)} == {0}
    out = U.encoded(docs, file)
    assert out.columns == [*docs.columns, "piece_ids"]
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert U.digests(docs.limit(0), file).collect() == []


# -- licences -----------------------------------------------------------------------------------


def test_licences_are_found_confirmed_or_unknown(spark):
    plain = ["the mountain was covered with snow this morning", "use the version that works for you", "all the rights and wrongs of it", ""]
    rows = [(i, "\n".join([plain[0], texts[0], plain[1]])) for i, texts in enumerate(C.TEMPLATES.values())]
    rows += [(50, "\n".join(plain)), (51, None), (52, ""), (53, "licensed under the terms of our public license agreement, all rights waived"), (0, rows[0][1])]
    rows += [(60 + i, f"{plain[i % 3]} number {i}\n{plain[(i + 1) % 3]}") for i in range(60)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, family string, line string")
    got = C.license_notices(docs).collect()
    known = {(r["doc_id"], r["paragraph"]): r["family"] for r in got if r["confirmed"]}
    assert known == {(i, 1): name for i, name in enumerate(C.TEMPLATES)}
    assert sum(r["doc_id"] == 0 for r in got) == 2
    assert not [r for r in got if r["doc_id"] in (50, 51, 52) or r["doc_id"] >= 60]
    assert {r["family"] for r in got if not r["confirmed"]} <= {"unknown"}
    assert C.license_notices(docs.limit(0)).collect() == []


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License version 2
as published by the Free Software Foundation.""",
}


def test_wrapped_licences_are_found(spark):
    names, marks = list(WRAPPED), ["", "# ", " * ", "// ", "REM ", "dnl "]
    rows = []
    for i, name in enumerate(names):
        for j, mark in enumerate(marks):
            notice = "\n".join(mark + x for x in WRAPPED[name].split("\n"))
            rows.append((10 * i + j, f"the mountain was covered with snow\r\n{mark.rstrip()}\r\n{notice}\n{mark}\nuse what works for you\n"))
    rows += [(100 + i, f"the weather of day {i}\nwas like that of the day before\n\nand so on") for i in range(60)]
    got = C.license_notices(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    found = {(r["doc_id"], r["family"]) for r in got if r["confirmed"]}
    assert found == {(10 * i + j, name) for i, name in enumerate(names) for j in range(len(marks))}
    assert {r["paragraph"] for r in got if r["lines"] > 1} == {2}
    assert not [r for r in got if r["doc_id"] >= 100]


def test_licence_paragraphs_keep_line_numbers(spark):
    text = "\n\n a b\n * c\n *\n  \nd\t1\n\u4e2d\n----\n7\n"
    row = spark.createDataFrame([(text,)], "t string").select(F.transform(C._paragraphs(F.col("t")), lambda p: C._candidates(p))).first()[0]
    got = [[tuple(c) for c in p] for p in row]
    assert got == [[(2, 1, "a b"), (3, 1, "c"), (2, 2, " a b c")], [(6, 1, "d\t1"), (7, 1, "\u4e2d"), (6, 2, " d\t1 \u4e2d")], [(9, 1, "7")]]


def test_ordinary_lines_come_from_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(C, "Classifier", lambda ordinary: seen.extend(ordinary))
    text = "snow " * 20_000 + "\n\nthe version of the documentation for this project\n"
    C.train(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    assert any({"version", "documentation", "project"} <= set(g) for g in seen)


def test_licence_grams_match_and_the_word_test_drops_nothing(spark):
    texts = [t for v in C.TEMPLATES.values() for t in v] + ["", "one", "Two words", "ABC-def 1.0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [sorted(r[0]) for r in df.select(C.grams(F.col("t"))).collect()] == [C.grams_of(t) for t in texts]
    model = C.Classifier([C.grams_of("an ordinary line of text about the weather")] * 5)
    rng = random.Random(5)
    pattern = re.compile(r"\b(?:" + "|".join(model.needed) + r")\b", re.I)
    place = {g: i for i, g in enumerate(model.grams)}
    for _ in range(500):
        own = C.grams_of(" ".join(rng.choices([w for t in texts for w in t.split()], k=rng.randint(1, 12))))
        x = np.zeros(len(place))
        x[[place[g] for g in own if g in place]] = 1
        z = (x @ model.w + model.b) / model.temperature
        p = np.exp(z - z.max())
        if p[-1] / p.sum() < 0.5:
            assert any(pattern.search(g) for g in own)


@needs_data
def test_licence_plan_is_native(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = C.scan(docs, C.train(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
