"""Operators of the training-data pipeline: nulls, empty and long texts, ties, repeated
rows, empty tables and clashing names; brute force, exact round trips, held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import bpe, chat, common, gam, graph, langid, licenses, mixing, ogg, perplexity, queries, sigtree, urlfilter

WORD = re.compile(common.WORD)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t", "é", "one two three", "a b c d e f g h " * 9, LONG, "a b c d e f g h " * 9, "x\x00y ☃ 漢字 z", "A" * 5000]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(1)

    def text(kind: str, n: int) -> str:
        parts = {"en": ["the", "of", "th", "ing", "er", "on", "at"], "de": ["der", "ung", "sch", "ein", "lich", "und"], "fr": ["les", "eau", "tion", "ment", "que", "oi"]}[kind]
        return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))

    return [(k, text(k, rng.randint(25, 80))) for k in ("en", "de", "fr") for _ in range(40)]


# ---------------------------------------------------------------- shared pieces


def test_words_are_the_pattern_s():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab \n\t\x0bé 漢", k=rng.randint(0, 30))) for _ in range(200)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    w = common.Words(data, bounds)
    got = [[bytes(data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [WORD.findall(t) for t in texts]
    h = w.hashes()
    same: dict = {}
    for k, word in enumerate(x for t in got for x in t):
        assert same.setdefault(word, h[k]) == h[k]
    assert len(set(same.values())) == len(same)


def test_slices_cover_all():
    bounds = np.array([0, 0, 10, 10, 500, 510, 510])
    assert list(common.slices(bounds, 100))[0] == (0, 3) and [j for _, j in common.slices(bounds, 100)][-1] == 6


# ---------------------------------------------------------------- 1


def base(text):
    w, seen, dup = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_metrics_are_brute_force(spark, odd):
    texts = [*ODD, "a\nb\na\n\n\nb", "x | y # z", "a a a a a a a a a"]
    got = {r.doc_id: r for r in perplexity.judge(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, *rest = base(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[3] > 30 * n)
        assert not (r.base_failed and r.kept)


def test_perplexity_rejects_noise_and_keeps_prose(spark, prose):
    rng = random.Random(4)
    noise = [(k, " ".join("".join(rng.choices(signs, k=7)) for _ in range(60))) for k in ("en", "de", "fr") for signs in ("qxzjkvw0123456789%&", "qxzjkvwy", "αβγδεζηθ")]
    rows = [(i, t, k, "s", 0) for i, (k, t) in enumerate([*prose, *noise])]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "verdict")
    kept = perplexity.keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(prose)))


def test_perplexity_of_other_scripts(spark):
    """Noise in Greek, Cyrillic or Han letters is outside the band of prose in them."""
    rng = random.Random(21)
    rows, noise = [], set()
    for lang, signs in (("el", "αβγδεζηθικλμνξοπρστυφχψω"), ("ru", "абвгдежзиклмнопрстуфхцчшыьэюя"), ("zh", "的一是不了人我在有他这为之大来以个中上们")):
        parts = ["".join(rng.choices(signs, k=3)) for _ in range(9)]
        for _ in range(50):
            rows.append((len(rows), " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(60, 90))), lang, "s", 0))
        for _ in range(2):
            noise.add(len(rows))
            rows.append((len(rows), " ".join("".join(rng.choices(signs, k=rng.randint(3, 9))) for _ in range(80)), lang, "s", 0))
    got = {r.doc_id: r for r in perplexity.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i for i in got if not got[i].kept} == noise


def test_perplexity_bands_follow_the_spread(spark):
    rng = random.Random(6)
    parts = ["the", "of", "th", "ing", "er", "on", "at"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(300)) for _ in range(60)]
    junk = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) + rng.choice("#$%&*") * 3 for _ in range(300)) for _ in range(12)]
    got = {r.doc_id: r for r in perplexity.judge(docs(spark, [*texts, *junk])).collect()}
    assert all(got[i].kept for i in range(60))
    assert not any(got[60 + i].kept or got[60 + i].base_failed for i in range(12))


def plain_symbols(text):
    """Code points and 1 of the words joined by single spaces (a space at the end stays)."""
    return [ord(c) + 1 for c in re.sub(r"[ \t-\r]+", " ", text or "").removeprefix(" ")]


def plain_grams(texts, n=5):
    out = Counter()
    for t in texts:
        x = [0] * (n - 1) + plain_symbols(t)
        out.update(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    return out


def plain_kneser_ney(counts):
    """p(gram) by the textbook's recursion, with modified discounts from the counts of counts."""
    tables = {5: counts}
    for k in (4, 3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    cuts, contexts = {}, {}
    for k, t in tables.items():
        n = [sum(v == i for v in t.values()) for i in range(5)]
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            cut = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
            cuts[k] = [0] + [min(max(c, 0.05), i - 0.05) for i, c in enumerate(cut) if i]
        else:
            cuts[k] = [0, 0.5, 0.5, 0.5]
        for g, v in t.items():
            contexts.setdefault((k, g[:-1]), []).append(v)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(tables[1]) + 1)
        seen = contexts.get((k, g[:-1]))
        if not seen:
            return p(g[1:])
        v, total = tables[k].get(g, 0), sum(seen)
        return (v - cuts[k][min(v, 3)]) / total + sum(cuts[k][min(x, 3)] for x in seen) / total * p(g[1:])

    return p


def test_plan_of_probabilities_is_one_order_s(spark):
    every = perplexity.counts(docs(spark, ["ab abc", "abcd b"]))
    longest = perplexity.probabilities(every, perplexity.fit(every))
    assert longest._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3 and len(longest.tables) == perplexity.ORDER - 1


def test_model_is_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcé漢 \n#", k=rng.randint(0, 90))) for _ in range(80)] + ["", None, "abc abc", "abc abc"]
    fold = [zlib.crc32((t or "").encode()) & 1 for t in texts]
    counts = [plain_grams([t for t, f in zip(texts, fold, strict=True) if f == k]) for k in (0, 1)]
    every = perplexity.counts(docs(spark, texts))
    got = {(r.fold, split(r.hi, r.lo)): r.n for r in every.where("k = 5").collect()}
    assert got == {(f, g): n for f in (0, 1) for g, n in counts[f].items()}
    model = perplexity.fit(every)
    for swap in (True, False):
        plain = [plain_kneser_ney(counts[1 - f if swap else f]) for f in (0, 1)]
        rows = perplexity.probabilities(every, model, swap).collect()
        assert len(rows) == len(got)
        assert all(math.isclose(r.p, plain[r.fold](split(r.hi, r.lo)), rel_tol=1e-9) for r in rows)
    # What may follow a context adds up to 1, with the share of what was never seen.
    p, unseen = plain_kneser_ney(counts[0]), 1
    alphabet = {g[-1] for g in counts[0]}
    for context in {g[:-1] for g in counts[0]}:
        assert sum(p((*context, c)) for c in alphabet) + p((*context, unseen)) == pytest.approx(1)


def split(hi, lo):
    low = (1 << 21) - 1
    return (hi >> 21, hi & low, lo >> 42, lo >> 21 & low, lo & low)


def test_large_models_are_dealt_out(spark, prose, monkeypatch):
    monkeypatch.setattr(perplexity, "BLOCK_BYTES", 2000)
    df = spark.createDataFrame([(i, t, k, "s", 0) for i, (k, t) in enumerate(prose)] + [(900 + i, t, None, "s", 0) for i, t in enumerate(ODD)] + [(7, "x y", "en", "s", 0)] * 3, DOCS).repartition(3)
    want = sorted(map(str, perplexity.scored(df, ["doc_id"]).collect()))
    assert sorted(map(str, perplexity.scored(df, ["doc_id"], most=0).collect())) == want


def test_quality_of_nothing(spark, odd):
    assert perplexity.judge(odd.limit(0)).count() == 0
    assert perplexity.keep_good(odd.where("doc_id = 0")).count() == 0


# ---------------------------------------------------------------- 2


def test_escaping_is_reversible():
    rng = random.Random(6)
    bits = ["<", "s>", "</s>\n", "[", "INST]", "[/INST]", "\\", "\n", "<|", "image:0|>", "<<SYS>>", "a"]
    for _ in range(3000):
        t, r = "".join(rng.choices(bits, k=rng.randint(0, 8))), "".join(rng.choices(bits, k=rng.randint(0, 3)))
        k = rng.randint(0, len(t))
        chunk, _ = chat.turn_chunk(r, chat.Visitor().flatten([chat.Part("text", t[:k]), chat.Part("text", t[k:])]))
        assert list(chat.read_turns(chunk)) == [(r, t)] and not chat.placeholders(chunk)


def test_parts_become_placeholders(spark):
    rows = spark.sql("""
      SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, array(
        named_struct('kind', 'text', 'text', 'see ', 'ref', CAST(NULL AS STRING), 'width', 0, 'height', 0, 'seconds', 0D, 'pages', 0),
        named_struct('kind', 'image', 'text', NULL, 'ref', 'i.png', 'width', 700, 'height', 300, 'seconds', 0D, 'pages', 0),
        named_struct('kind', 'audio', 'text', NULL, 'ref', 'a.ogg', 'width', 0, 'height', 0, 'seconds', 2D, 'pages', 0)) AS content
      UNION ALL SELECT 1L, 1L, 'assistant', array(
        named_struct('kind', 'document', 'text', NULL, 'ref', 'd.pdf', 'width', 0, 'height', 0, 'seconds', 0D, 'pages', 3))""")
    got = chat.format_turns(rows, "content").orderBy("place").collect()
    assert got[0].chunk == "<s>user\nsee <|image:0|><|audio:1|></s>\n"
    assert [(a.number, a.kind, a.ref, a.tokens) for r in got for a in r.attachments] == [(0, "image", "i.png", 3 * 144), (1, "audio", "a.ogg", 50), (2, "document", "d.pdf", 768)]
    assert got[1].at == len(got[0].chunk) and got[1].chunk[got[1].loss_start : got[1].loss_end] == "<|document:2|>"
    assert got[0].loss_start is None and got[0].expanded_tokens == 482


def test_chat_digests(spark):
    turns = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "user", "n"), (1, 1, "assistant", "b</s>")]
    df = chat.with_probe(spark, spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    probe = "</s>[INST] ok [/INST]"
    assert set(got) == {1, 2, None, -7}
    assert (got[-7].turns_sha256, got[-7].loss_sha256, got[-7].loss_chars) == (sha(f"user\n{probe}\nassistant\n{probe}\n"), sha(probe), len(probe))
    assert got[1].n_turns == 3 and got[1].loss_sha256 == sha("b</s>b</s>") and got[2].turns_sha256 == sha("\nx\n")
    assert chat.digests(df.where("conv_id = 99")).count() == 0


# ---------------------------------------------------------------- 3


def test_bpe_is_the_library_s(spark, odd):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = queries.vocabulary()
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.Encoder(ranks, pattern)
    rng = random.Random(7)
    texts = ["".join(rng.choices("aabn '\n\té漢🙂0!,sd", k=rng.randint(0, 60))) for _ in range(500)] + ["ab" * 20_000, "a" * 30_000]
    for t in texts:
        ids = library.encode_ordinary(t)
        packed = ours.encode(t)
        assert packed == struct.pack(f"<{len(ids)}I", *ids) and ours.decode(packed) == t.encode()
    got = {r.doc_id: r for r in bpe.digests(odd, path, pattern).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_rank_queue_pops_in_order():
    rng = random.Random(8)
    q = bpe.RankQueue(50_000)
    want = sorted((rng.randrange(50_000), rng.randrange(1000)) for _ in range(2000))
    for rank, position in rng.sample(want, len(want)):
        q.push(rank, position)
    assert [q.pop() for _ in want] == want and q.pop() is None


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 5 * (bpe.ENTRY + 10))
    e = bpe.Encoder({bytes([b]): b for b in range(256)}, r"\S+|\s+")
    text = " ".join(str(k % 17) for k in range(500))
    assert e.decode(e.encode(text)) == text.encode() and len(e) <= 5 and len(e.old) <= 5


def test_encoders_go_with_the_next_operator(spark, tmp_path):
    path = tmp_path / "bytes.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(256)))

    def held(batches):
        from tickloom.llm import bpe

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe._encoders)] * len(batch))], ["n"])

    df = spark.range(800).selectExpr("id AS doc_id", "concat('word ', id) AS text").repartition(8)
    for _ in range(2):
        assert bpe.digests(df, str(path), r"\S+|\s+").count() == 800
        assert {r.n for r in df.mapInArrow(held, "n long").collect()} == {0}


# ---------------------------------------------------------------- 4


def test_licences(spark):
    texts = [
        "x.\nLicensed under the Apache License, Version 2.0.\ny", "Intro. Released under the MIT License. This work is licensed under the GNU General Public License, version 3.",
        'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "the apache license", "LICENSED under   CC by-nc 4.0", None, "", "SPDX-License-Identifier: MIT",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ]
    got = {r.doc_id: r for r in licenses.report(docs(spark, texts)).collect()}
    assert [got[i].licence for i in range(len(texts))] == ["Apache-2.0", "MIT", "MIT", None, "CC-BY-NC-4.0", None, None, "MIT", "GPL-3.0-or-later"]
    assert got[1].licences == "MIT GPL-3.0-only" and got[1].n_sentences == 2 and got[5].sentence_ids == ""
    assert licenses.report(docs(spark, texts).limit(0)).count() == 0
    import duckdb

    c = duckdb.connect()
    frame = docs(spark, texts).toPandas()
    c.register("frame", frame)
    assert sorted(map(tuple, got.values())) == sorted(c.execute(licenses.oracle("frame")).fetchall(), key=lambda r: r[0])


MIT = """MIT License

Copyright (c) 2020 X

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


def as_duckdb_reads_them(texts, got):
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    c.register("frame", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    assert sorted(map(tuple, got.values())) == sorted(c.execute(licenses.oracle("frame")).fetchall())


def test_wrapped_licences(spark):
    texts = [x for t in (MIT, GPL, GPL.replace("software:", "software;").replace("tion, either version 3", "tion; either version 2"), BSD) for x in (t, " * " + t.replace("\n", "\n * "), t.replace("\n", "\r\n-- "))]
    texts += ["a title\nReleased under the MIT License\nmore", "Released under\n\nthe MIT License"]
    got = {r.doc_id: r for r in licenses.report(docs(spark, texts)).collect()}
    want = ["MIT"] * 3 + ["GPL-3.0-or-later"] * 3 + ["GPL-2.0-or-later"] * 3 + ["BSD-3-Clause"] * 3 + ["MIT", None]
    assert [got[i].licence for i in range(len(texts))] == want
    as_duckdb_reads_them(texts, got)
    assert got[0].sentence_ids == "mit-title mit-grant mit-condition as-is" and got[3].sentence_ids == "gpl-free gpl-redistribute gpl-version-3"


def test_padded_licences(spark):
    texts = ["Released under" + " #" * 5000 + " the MIT License", "- " * 200_000, "Released" + " " * 3000 + "under the MIT License", "a\n" * 50_000 + "SPDX-License-Identifier: ISC"]
    got = {r.doc_id: r for r in licenses.report(docs(spark, texts)).collect()}
    assert [got[i].licence for i in range(4)] == ["MIT", None, "MIT", "ISC"]
    as_duckdb_reads_them(texts, got)


def test_licences_of_random_sentences(spark):
    """Sentences of the table, cut, wrapped and padded at random, as DuckDB reads them."""
    rng = random.Random(15)
    known = [*licenses.SENTENCES.values(), *(x for _, x in licenses.FULL), "not a licence", "the software"]
    joints = [". ", ".\n", "\n", "\n\n", " ", "; ", "!\r\n", "\n# ", ".", " -- "]
    texts = ["".join(re.sub(" ", lambda m: rng.choice([" ", " ", " ", "  ", "\n * ", "\r\n"]), rng.choice(known)) + rng.choice(joints) for _ in range(rng.randint(1, 8))) for _ in range(300)]
    got = {r.doc_id: r for r in licenses.report(docs(spark, texts)).collect()}
    as_duckdb_reads_them(texts, got)
    assert sum(r.licence is not None for r in got.values()) > 100


def test_licences_carry_columns(spark):
    rows = docs(spark, ["SPDX-License-Identifier: MIT", None]).selectExpr("*", "'mine' AS licence", "1 AS Sentence_IDs")
    got = licenses.scan(rows)
    assert got.columns == [*rows.columns, "sentence_ids_", "licences", "licence_"]
    assert [(r.licence, r.licence_) for r in got.orderBy("doc_id").collect()] == [("mine", "MIT"), ("mine", None)]


# ---------------------------------------------------------------- 5


def test_languages_held_out(spark, prose):
    rows = [(i, t, k, "s", 0) for i, (k, t) in enumerate(prose)] + [(500 + i, t, None, "s", 0) for i, t in enumerate([None, "", "123 %", "der die lichung"])]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame([*rows, (None, prose[0][1], "en", "s", 0)], DOCS)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(len(prose)))
    assert np.mean([got[i].lang_pred == k for i, (k, _) in enumerate(prose) if got[i].held_out]) > 0.95
    assert [got[500 + i].lang_pred for i in range(4)] == ["und", "und", "und", "de"] and got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())


def test_rank_distance_is_the_definition():
    profiles = langid.Profiles([("a", 1, 1), ("a", 2, 2), ("b", 2, 1), ("b", 3, 2)], top=4)
    # own profile 2, 1: a is out of place by 1 + 1, b by 0 and 4 (missing).
    assert profiles.nearest(np.array([2, 1], np.uint64)) == ("a", 1 - 2 / 8)
    assert langid.Profiles([]).nearest(np.array([2], np.uint64)) == ("und", 0.0)


def plain_profile(texts, top=300):
    """The most frequent letter n-grams of texts; words edged by U+0001, ties by the packed symbols."""
    n = Counter()
    for t in texts:
        letters = [ord(x.lower()) + 2 if x.isalpha() else 1 for x in t or ""]
        stream = [c for i, c in enumerate(letters) if c > 1 or i and letters[i - 1] > 1]
        for i, c in enumerate(stream):
            back = [1, 1, *stream[:i]][-2:]
            n[(c,)] += c > 1
            n[back[1], c] += 1
            if i:
                n[back[0], back[1], c] += 1
    number = lambda g: sum(c << 21 * k for k, c in enumerate(reversed(g)))
    return sorted((g for g in n if n[g]), key=lambda g: (-n[g], number(g)))[:top]


@pytest.mark.parametrize("most", [langid.MOST_LANGUAGES, 1])
def test_languages_are_brute_force(spark, prose, most):
    rows = [(i, t, k, "s", 0) for i, (k, t) in enumerate(prose)] + [(900 + i, t, "xx", "s", 0) for i, t in enumerate(["Ärger ... ab", "a b\nc", "", "12"])]
    df = spark.createDataFrame(rows, DOCS)
    profiles = {k: plain_profile(t for _, t, own, *_ in rows if own == k) for k in ("de", "en", "fr", "xx")}
    got = {r.doc_id: r for r in langid.predict(df, langid.fit(df, most=most), ["doc_id", "text"]).collect()}
    for i, t, *_ in rows:
        own = plain_profile([t])
        if not own:
            assert (got[i].lang_pred, got[i].score, got[i].text) == ("und", 0.0, t)
            continue
        far = {k: sum(abs(p.index(g) - r) if g in p else 300 for r, g in enumerate(own)) for k, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        assert (got[i].lang_pred, got[i].text) == (best, t) and got[i].score == pytest.approx(1 - far[best] / (300 * len(own)))


def peak(run, batch) -> int:
    """Bytes that a task's function takes at most besides its input and what it keeps from task to task."""
    list(run(iter([batch.slice(0, 100)])))
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_languages_take_little_memory():
    rng = random.Random(14)
    texts = ["".join(rng.choices("abcdefgh  ", k=2000)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 500), pa.array(texts)], ["lang", "text"])
    profiles = langid.Profiles([("en", 99, 1), ("de", 100, 1)])
    assert peak(langid._trained, batch) < 30 << 20
    assert peak(langid._predicted(SimpleNamespace(value=profiles), 1, 1), batch) < 30 << 20


def test_counts_of_slices_add_up():
    rng = random.Random(15)
    total, want = None, Counter()
    for _ in range(30):
        keys = np.array(rng.choices(range(1, 200), k=rng.randint(1, 40)), np.uint64)
        want.update(keys.tolist())
        total = langid._added(*total, *langid._counts(keys)) if total else langid._counts(keys)
    total = langid._added(*total, *langid._counts(np.zeros(3, np.uint64)))
    assert list(zip(total[0].tolist(), total[1].tolist(), strict=True)) == sorted(want.items())


def test_languages_of_nothing(spark, odd):
    assert langid.identify(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs(spark, ["abc", "d"], lang=None)).collect()} == {"und"}
    named = odd.withColumnRenamed("n_chars", "Score")
    assert langid.keep_known(named).columns == named.columns


# ---------------------------------------------------------------- 6


def test_urls(spark):
    urls = [
        "https://WWW.X.net/a?b#c", "http://x.example.net/en/1", "http://x.example.net/EN/1", "https://example.com/de/", "http://a.org/fr/x", "http://net", "http://netx/", None, "nothing", "ads://h?x/y", "http://ads-track.x.test/click",
        "http://www.library.test/en/books", "http://éÄ.net/ü", "http://",
    ]
    got = [tuple(r)[1:] for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert [g[:3] for g in got[:10]] == [
        ("www.x.net", "/a", "net/"), ("x.example.net", "/en/1", "example.net/en/"), ("x.example.net", "/EN/1", "net/"), ("example.com", "/de/", "example.com/de/"), ("a.org", "/fr/x", "org/fr/"),
        ("net", "", None), ("netx", "/", None), ("", "", None), ("", "", None), ("h", "", None),
    ]
    assert [g[3] for g in got[:5]] == ["block", "allow", "block", "block", "allow"] and got[10][3] == "block" and got[11][3] == "allow" and got[12][:2] == ("éÄ.net", "/ü")
    weights, plain = urlfilter.train(spark), urlfilter.plain_model()
    assert weights.keys() == plain.keys() and all(math.isclose(w, plain[k], abs_tol=1e-9) for k, w in weights.items())
    import duckdb

    c = duckdb.connect()
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").toPandas()
    c.register("frame", frame)
    assert [r[1:] for r in sorted(c.execute(urlfilter.oracle("frame")).fetchall())] == got


def test_url_model_on_hosts_it_has_not_seen(spark):
    """Bad hosts with harmless paths, and harmless ones, none of them in the labelled table."""
    bad = ["casino", "bets", "pills", "adult", "spam", "ads", "slots", "xxx", "viagra", "loans"]
    good = ["orchard", "thermal", "nations", "teatre", "ponder", "shelter", "onward", "winter", "cinders", "blender", "adagio", "spandau", "farming", "clicks-and-mortar"]
    frame = lambda host, k: f"https://{('www.', 'm.', 'blog.', '')[k % 4]}{host}.example.com/{('en', 'fr', 'es')[k % 3]}/{1000 + 37 * k}{('', '.html', '?page=2')[k % 3]}"
    urls = [(k, frame(f"{x}-{y}" if k % 2 else f"{y}-{x}", k), x in bad) for k, (x, y) in enumerate((x, y) for x in [*bad, *good] for y in ("zone", "room", "today", "mart"))]
    got = {r.page_id: r.verdict == "block" for r in urlfilter.judge(spark.createDataFrame(urls, "page_id long, url string, verdict boolean")).collect()}
    assert np.mean([got[k] for k, _, x in urls if x]) >= 0.9
    assert np.mean([got[k] for k, _, x in urls if not x]) <= 0.02


def test_urls_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, Host string")
    assert urlfilter.judge(empty).columns == ["page_id", "host", "path", "rule", "verdict"] and urlfilter.judge(empty).count() == 0


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 65_024, 65_025, 65_026, 200_000])
def test_ogg_round_trip(n):
    data = bytes(i * 7 % 251 for i in range(n))
    back = ogg.load(ogg.store(data))
    assert back.n_bytes == n and back.payload == data + bytes(max(64, -(-n // 64) * 64) - n)
    assert back.seconds[-1] == len(back.payload) / ogg.RATE
    packets = [(b"h", 0), (data, 5), (b"", 5), (data[:3], 9)]
    streams = ogg.demultiplex(ogg.multiplexed([ogg.paged(3, packets), ogg.paged(9, packets[:2])]))
    assert streams[3].packets == [p for p, _ in packets] and streams[9].packets == [p for p, _ in packets[:2]]


def test_ogg_checksum_is_the_definition():
    def slow(data: bytes) -> int:
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
        return crc

    for data in (b"", b"a", b"OggS" + bytes(range(256))):
        assert ogg.checksum(data) == slow(data)


def test_ogg_damage_is_found():
    good = ogg.store(b"x" * 70_000)
    for at in (0, 5, 22, 30, 400, len(good) - 1):
        with pytest.raises(ValueError):
            ogg.demultiplex(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
    for cut in (10, 100, len(good) - 5):
        with pytest.raises(ValueError):
            ogg.demultiplex(good[:cut])


def test_ogg_digests(spark, odd):
    got = {r.doc_id: r for r in ogg.digests(odd).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[5][1:] == got[7][1:] and got[0][1:] == got[1][1:]


# ---------------------------------------------------------------- 8


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def shingles(text, n=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def family(rng, n, copies, edits):
    words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    out = []
    for _ in range(copies):
        own = list(words)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("block", "m"), [(sigtree.BLOCK, sigtree.QUERY), (600, sigtree.QUERY), (600, sigtree.STAGE)])
def test_jaccard_join_is_brute_force(spark, block, m):
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [*ODD, "ONE two three", "one two", "A b C d", "a b c d", *family(rng, 120, 40, 5), *family(rng, 50, 30, 3), *family(rng, 300, 8, 12)]
    texts += [f"{passage} {t}" for t in family(rng, 40, 1, 0) + family(rng, 200, 2, 9)] + [passage + f" tail{k}" for k in range(5)] + [passage] * 3
    rng.shuffle(texts)
    sets = [shingles(t, m.words) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= m.link * len(sets[i] | sets[j])]
    want = components(pairs, range(len(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sigtree.join(docs(spark, texts), m, block).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}


def test_tree_join_is_brute_force():
    rng = random.Random(10)
    for _ in range(30):
        base_ = [np.unique(np.array([rng.randrange(1 << 60) for _ in range(rng.randint(1, 60))], np.uint64)) for _ in range(4)]
        sets = []
        for _ in range(rng.randint(2, 90)):
            s = rng.choice(base_)
            drop = rng.randint(0, len(s) // 6)
            sets.append(np.unique(np.append(s[drop:], [np.uint64(rng.randrange(1 << 60)) for _ in range(rng.randint(0, 2))])).astype(np.uint64))
        sides = np.array([rng.randrange(2) for _ in sets]) if rng.random() < 0.5 else np.zeros(len(sets), int)
        plain = [set(s.tolist()) for s in sets]
        two = sides.any() and not sides.all()
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (not two or sides[i] != sides[j]) and 100 * len(plain[i] & plain[j]) >= 85 * len(plain[i] | plain[j])]
        if sides.all():
            continue
        root = sigtree.Join(sets, sides, 85).root
        want = components(pairs, range(len(sets)))
        assert {i: j for i, j in enumerate(root)} == want


def test_jaccard_join_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, None)], "doc_id long, text string").selectExpr("*", "'x' AS n", "1 AS unit", "'l' AS lang")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in sigtree.join(df).collect()))
    assert got == [(0, 2, None), (3, 2, 3), (3, 2, 3), (5, 2, 3), (9, 0, 9)]
    kept = sigtree.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 9]
    assert sigtree.join(df.limit(0)).count() == 0


def test_jaccard_join_of_ids_on_several_texts(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l"), (3, "g h i j k l"), (4, "m n o p"), (4, "q r s t"), (5, "q r s t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted({(r.doc_id, r.component_id) for r in sigtree.join(df).collect()}) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    want = min(("m n o p", "q r s t"), key=lambda x: hashlib.sha256(x.encode()).hexdigest())
    assert sorted(map(tuple, sigtree.keep_one(df.repartition(3), sigtree.QUERY).collect())) == [(1, "a b c d e f"), (4, want)]


def test_frequent_shingles_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(sigtree, "FREQUENT_MOST", 20)
    df = docs(spark, [" ".join(f"w{k}" for k in range(j, j + 60)) for j in range(40)] * 2 + ["p q r s t"] * 300)
    assert len(sigtree.frequent(df, sigtree.QUERY)) == 2  # each of at least a twentieth of all shingles
    monkeypatch.setattr(sigtree, "FREQUENT_MOST", 1000)
    assert len(sigtree.frequent(df, sigtree.QUERY)) > 20


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# ---------------------------------------------------------------- 9


def test_quality_held_out(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(rng.randint(10, 60))]
        text = " ".join(words) + "." if good else rng.choice([" ".join(w + "###" for w in words), " ".join(words).upper() + "!!", " ".join([words[0]] * 40)])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (900, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in gam.classify(df, lab).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [i for i in range(400) if got[i].held_out]
    assert held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.93
    assert {r.score for r in gam.classify(df, lab.limit(0)).collect()} == {0.5}


def plain_gam(x, y):
    """The boosting of lookup tables by plain loops over rows."""
    n, width = len(y), len(x[0])
    edges = [sorted({float(np.quantile([r[j] for r in x], q)) for q in np.linspace(0, 1, gam.BINS + 1)[1:-1]}) for j in range(width)]
    bins = [[sum(e <= r[j] for e in edges[j]) for j in range(width)] for r in x]
    p = (sum(y) + 1) / (n + 2)
    out = [math.log(p / (1 - p))] * n
    for _ in range(gam.ROUNDS):
        for j in range(width):
            g, h = [0.0] * (len(edges[j]) + 1), [0.0] * (len(edges[j]) + 1)
            for r in range(n):
                q = 1 / (1 + math.exp(-out[r]))
                g[bins[r][j]] += q - y[r]
                h[bins[r][j]] += q * (1 - q)
            leaves = [(0, len(g))]
            for _ in range(gam.CUTS):
                found = []
                for a, b in leaves:
                    for k in range(a + 1, b):
                        gl, hl, gr, hr = sum(g[a:k]), sum(h[a:k]), sum(g[k:b]), sum(h[k:b])
                        if hl >= gam.LEAST / 4 and hr >= gam.LEAST / 4:
                            found.append((gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1), a, b, k))
                best = max(found, default=(0, 0, 0, 0), key=lambda f: f[0])
                if best[0] <= 1e-9:
                    break
                leaves.remove(best[1:3])
                leaves += [(best[1], best[3]), (best[3], best[2])]
            for r in range(n):
                a, b = next(v for v in leaves if v[0] <= bins[r][j] < v[1])
                out[r] -= gam.RATE * sum(g[a:b]) / (sum(h[a:b]) + 1)
    return [1 / (1 + math.exp(-v)) for v in out]


def test_boosting_is_brute_force(monkeypatch):
    monkeypatch.setattr(gam, "ROUNDS", 6)
    monkeypatch.setattr(gam, "PAIR_ROUNDS", 0)
    rng = random.Random(16)
    x = [[rng.random(), rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0])] for _ in range(160)]
    y = [float(r[0] + 0.3 * r[1] + 0.2 * r[2] + rng.gauss(0, 0.2) > 0.7) for r in x]
    assert np.allclose(gam.fit(np.array(x), np.array(y)).score(np.array(x)), plain_gam(x, y))


def test_gam_finds_an_interaction():
    rng = np.random.default_rng(12)
    x = rng.random((3000, len(gam.FEATURES)))
    y = ((x[:, 1] > 0.5) ^ (x[:, 4] > 0.5)).astype(float)
    model = gam.fit(x[:2500], y[:2500])
    assert ((model.score(x[2500:]) > 0.5) == y[2500:]).mean() > 0.9
    assert gam.fit(x[:10], np.ones(10)).score(x[:1])[0] > 0.8


# ---------------------------------------------------------------- 10


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        goal = {s: left * weight[s] / max(1, sum(weight[f] for f in free)) for s in free}
        over = {s for s in free if goal[s] > 3 * sizes[s]}
        if not over:
            return goal | {s: 3 * sizes[s] for s in capped}
        capped |= over


def test_mixing(spark):
    rng = random.Random(13)
    source = [None, "b", "a", "é", "c", "tiny", "empty"]
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)) if (s := rng.choice(source[:5])) else None, s) for i in range(600)]
    rows += [(700, "one word", "tiny"), (701, None, "empty"), (None, "x y", "a"), (3, "again", "b"), (3, "again", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(df.repartition(7)).collect())) and len(got) == len(rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    by_size = {}
    for r in got:
        by_size.setdefault((r.source_size, round(r.target, 6)), []).append(r)
        assert r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
    for s, n in sizes.items():
        group = by_size[n, round(want[s], 6)]
        assert abs(sum(r.taken for r in group) - want[s]) <= 9 * max(1, len(group) / 100) + 4
    kept = mixing.taken(df.withColumn("mix", df.doc_id))
    assert kept.columns == ["doc_id", "text", "source", "mix"]
    assert kept.count() == sum(r.taken // r["size"] for r in got if r["size"]) + sum(1 for r in got if not r["size"] and False) + kept.where("text IS NULL OR text = ''").count()
    assert mixing.plan(df.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables aren't here")
    import corpus_pipeline

    start = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, before = start, start
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name))
        before, rows = rows, spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert rows.columns == start.columns
            assert rows.join(before, "doc_id", "left_anti").count() == 0
    assert rows.count() == before.count() and rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()) == sorted(rows.collect())


CLASHES = ("verdict", "bits", "m_units", "lang_pred", "Score", "p0", "c0", "n", "set", "prefix", "unit", "taken", "size", "ids", "decoded", "block", "fold")


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_of_odd_rows(spark, prose, tmp_path, empty):
    """Nulls in every column, empty and long texts, repeated rows, more columns with clashing names; and no rows."""
    import corpus_pipeline

    rows = [(i, t, k, f"s{i % 3}", len(t)) for i, (k, t) in enumerate(prose)]
    rows += [(200 + i, t, "en", "s0", 1) for i, t in enumerate(ODD)] + [(0, *rows[0][1:]), (300, rows[1][1], None, None, None), (None, rows[2][1], None, None, None), (None, None, None, None, None)]
    start = spark.createDataFrame(rows, DOCS).selectExpr("*", *[f"CAST(NULL AS STRING) AS {c}" for c in CLASHES])
    docs_ = start.limit(0) if empty else start
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs_, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == start.columns
            assert after.join(docs_, after.text.eqNullSafe(docs_.text), "left_anti").count() == 0
        assert (after.count() == 0) == empty
        docs_ = after


def test_partners_in_large_groups_only(spark, monkeypatch):
    """With groups of two at most nearly all shared shingles are in large groups."""
    monkeypatch.setattr(sigtree, "GROUP", 2)
    rng = random.Random(14)
    texts = family(rng, 100, 12, 3)
    texts += [f"{t} {' '.join(f'x{rng.randrange(10**6)}' for _ in range(rng.randint(0, 14)))}" for t in texts[:8]]
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = components(pairs, range(len(texts)))
    assert {r.doc_id: r.component_id for r in sigtree.join(docs(spark, texts)).collect()} == want
