"""The operators against brute force on small tables, and their edge cases."""

import collections
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tandem.llm import itq, language_model, licenses, mixing, positions, quality, sharding, simhash, token_files, toxicity
from tandem.llm.components import components
from tandem.llm.elias_fano import EliasFano, encode
from tandem.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, fp string"
ODD = [
    (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "b", 1, None, None),
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "b", 1, None, None),
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "b", 1, None, None),
    (2, None, None, None, None, None, None),
    (4, "", "en", "a", 0, "x", "y"),
    (5, "  \n\t ", "en", "a", 0, None, None),
    (None, "one", "en", None, 3, None, None),
    (6, "word " * 30_000, "en", "c", 3, None, None),
    (7, "Licensed under the Apache License, Version 2.0.\nÉtude ßx <|endoftext|> 日本", "de", "a", 3, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize(("n", "top"), [(0, 9), (1, 0), (9, 3), (4000, 10**6), (3000, 2**62)])
def test_elias_fano(n, top):
    draw = np.random.default_rng(n)
    values = np.sort(draw.integers(0, top + 1, n).astype(np.uint64))
    code = EliasFano(encode(values))
    assert (code.all() == values).all()
    at = draw.integers(0, max(n, 1), min(n, 500))
    assert (code.access(at) == values[at]).all()
    asked = np.r_[draw.integers(0, top + 2, 500).astype(np.uint64), values[:200]]
    assert (code.successor(asked) == np.searchsorted(values, asked)).all()
    assert ((code.find(asked) >= 0) == np.isin(asked, values)).all()


def test_components_of_chains_hubs_and_nothing(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(50)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    groups = collections.defaultdict(set)
    for node, root in got.items():
        groups[root].add(node)
    assert sorted(map(len, groups.values())) == [2, 51, 61]
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_fingerprint_bits():
    text = "The quick Brown fox jumps over the lazy dog the quick brown fox jumps"
    words = low(text).split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert int.from_bytes(simhash.fingerprint(text), "big") == want
    assert simhash.fingerprint("") == bytes(8)
    assert simhash.fingerprint("A b") == xxhash.xxh64_digest(b"a b", 42)


@pytest.mark.parametrize("radius", [4, 20])
def test_shard_links_span_all_pairs(radius):
    draw = np.random.default_rng(radius)
    fp = draw.integers(0, 2**63, 900).astype(np.uint64)
    fp[1::3] = fp[::3] ^ np.uint64(0b1011)
    fp = np.unique(fp)
    draw.shuffle(fp)
    shard = np.unique(np.sort(draw.integers(0, 9, len(fp))), return_inverse=True)[1]
    a, b = simhash.shard_links(shard, np.stack([fp, np.zeros_like(fp)], axis=1), radius)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    x, y = np.nonzero(near & (shard[:, None] == shard[None, :]))
    place = {int(v): k for k, v in enumerate(fp)}
    got = simhash._local_components(len(fp), *(np.array([place[int(v)] for v in s], int) for s in (a, b)))
    assert (got == simhash._local_components(len(fp), x, y)).all()


def test_crowded_shards_are_cut_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 16)
    draw = np.random.default_rng(5)
    base = int(draw.integers(0, 2**62))
    fps = list({base ^ sum(1 << int(b) for b in draw.choice(40, 3, replace=False)) for _ in range(120)} | {int(x) for x in draw.integers(0, 2**62, 60)})
    rows = spark.createDataFrame([(k, f, 0) for k, f in enumerate(fps)], "doc_id bigint, fp bigint, fp2 bigint")
    got = {r.doc_id: r.component_id for r in simhash.component_ids(rows).collect()}
    v = np.array(fps, np.uint64)
    a, b = np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4)
    assert got == dict(enumerate(simhash._local_components(len(v), a, b).tolist()))


def test_simhash_odd_rows(docs, none):
    prints = simhash.fingerprints(docs)
    got = collections.Counter(r.component_id for r in simhash.component_ids(prints).collect())
    # 1, 1, 3 are copies; null, empty and blank texts share fingerprint zero.
    assert got[1] == 3 and got[2] == 3 and sum(got.values()) == len(ODD)
    assert simhash.component_ids(simhash.fingerprints(none)).count() == 0


def test_language_model_is_the_smoothed_model(spark, none):
    draw = np.random.default_rng(3)
    texts = [" ".join(draw.choice(["A", "b", "c", "d", "e"], int(draw.integers(0, 12)))) for _ in range(60)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in language_model.score(rows, F.col("doc_id") % 5 == 0).collect()}
    tokens = [low(t).split() + [None] for t in texts]
    train = [k for k in got if k % 5]
    counts = [collections.Counter() for _ in range(3)]
    for k in train:
        s = ["<", "<", *tokens[k]]
        for i in range(2, len(s)):
            for o in range(3):
                counts[o][tuple(s[i - o : i + 1])] += 1
    n, v, m = sum(counts[0].values()), len(counts[0]), got[0].strength

    def p(gram):
        if len(gram) == 1:
            return (counts[0][gram] + 1) / (n + v + 1)
        head = gram[:-1]
        total = len(train) if set(head) == {"<"} else counts[len(head) - 1][head]
        return (counts[len(head)][gram] + m * p(gram[1:])) / (total + m)

    for k, row in got.items():
        s = ["<", "<", *tokens[k]]
        assert row.train_tokens == n and row.n_tokens == len(tokens[k])
        assert row.n_known == sum(counts[0][(w,)] > 0 for w in tokens[k])
        assert row.base_score == pytest.approx(sum(np.log10(p((w,))) for w in tokens[k]))
        assert row.score == pytest.approx(sum(np.log10(p(tuple(s[i - 2 : i + 1]))) for i in range(2, len(s))), abs=0.001 * len(s))
    assert sum(p(("A".lower(), "b", w)) for w in ["a", "b", "c", "d", "e", None, "unknown"]) == pytest.approx(1)
    assert language_model.score(none, F.lit(False)).count() == 0


def test_language_model_odd_rows(docs):
    got = language_model.score(docs, F.col("doc_id") == 1).collect()
    assert len(got) == len(ODD) and all(r.score < 0 for r in got)
    nothing = language_model.score(docs, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in nothing)


def test_token_files_round_trip(spark, docs, none, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    exact = tokenizers.Tokenizer.from_file(vocabulary())
    folder = tmp_path.as_uri()
    manifest = token_files.write(docs, folder, vocabulary())
    got = token_files.read(spark, folder, manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in ODD), key=lambda x: (x is not None, x))
    texts, start = {r[0]: r[1] for r in ODD}, 0
    for r in got:
        ids = np.array([*exact.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.read(spark, folder, token_files.write(none, folder, vocabulary())).count() == 0


def test_encoder_cuts_as_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    exact = tokenizers.Tokenizer.from_file(vocabulary())
    draw = np.random.default_rng(9)
    bits = ["a", "B", " ", "  ", "\n", "\n\n", "'s", "'", "é", "é", "1", "²", "_", ".", "\t", " ", "Hello", "'ll", "!", "<|endoftext|>", "\r\n", "日本", "\x1c"]
    texts = ["".join(draw.choice(bits, int(draw.integers(0, 25)))) for _ in range(4000)]
    got = token_files.Encoder(vocabulary()).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == exact.encode(text, add_special_tokens=False).ids


def test_interleaving(spark, docs, none):
    rows = spark.createDataFrame([(k, "hot" if k % 3 == 0 else f"s{k % 7}" if k % 11 else None) for k in range(2000)], "id bigint, source string")
    got = sharding.interleave(rows, "source", 24, "id").collect()
    sizes = collections.Counter(r.shard for r in got)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    mix, whole = collections.Counter((r.shard, r.source) for r in got), collections.Counter(r.source for r in got)
    assert all(abs(mix[s, q] - whole[q] / 24) < 2 for s in sizes for q in whole)
    assert sharding.interleave(docs, "source", 24, "doc_id", "text").count() == len(ODD)
    assert sharding.interleave(none, "source", 24, "doc_id").count() == 0


def test_mixing_meets_targets(spark, none):
    draw = np.random.default_rng(2)
    rows = [(k, [None, "a", "b", "c"][min(int(draw.integers(0, 9)), 3)], int(draw.integers(0, 40))) for k in range(3000)] + [(1, "empty", 0)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")).collect()
    total, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        total[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    assert sum(target.values()) == pytest.approx(sum(total.values()))
    for source, goal in target.items():
        assert goal <= 3 * total[source] + 1e-6 and abs(taken[source] - goal) <= 20
    assert mixing.mix(none.withColumn("size", F.lit(1))).count() == 0


def test_phrases_against_brute_force(spark, docs, none, monkeypatch):
    monkeypatch.setattr(positions, "BLOCK_WORDS", 300)
    draw = np.random.default_rng(4)
    vocabulary_ = list("abcdefgh")
    texts = [" ".join(draw.choice(vocabulary_, int(draw.integers(0, 90)))) for _ in range(60)] + [None, "A-b.C"]
    items = [" ".join(draw.choice(vocabulary_, 6)) for _ in range(25)] + ["", None, "b c", "!"]
    items[0] = " ".join(texts[0].split()[3:12]) or items[0]
    docs_ = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items_ = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    window = 5

    def want(text):
        words, hit, held = re.findall(r"[a-z0-9]+", low(text)), set(), set()
        for k, item in enumerate(items):
            w = re.findall(r"[a-z0-9]+", low(item))
            n = min(window, len(w))
            grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in grams:
                    held.add(str(k))
                    hit.update(range(i, i + n))
        return len(words), hit, held

    for most in (10**6, 20):
        monkeypatch.setattr(positions, "QUERY_WORDS", most)
        for r in positions.phrase_spans(positions.build_index(docs_), items_, window=window).collect():
            n, hit, held = want(texts[r.doc_id])
            assert r.n_words == n and set(r["items"]) == held
            assert {i for s in r.spans for i in range(s.start, s.end)} == hit
    assert positions.phrase_spans(positions.build_index(none), items_).count() == 0
    found = positions.phrase_spans(positions.build_index(docs), spark.createDataFrame([], "item_id bigint, text string")).collect()
    assert len(found) == len(ODD) and not any(r.spans for r in found)


def test_proximity(spark):
    rows = spark.createDataFrame([(1, "x a b c y"), (2, "x b b b b y"), (3, "y x"), (4, "x")], "doc_id bigint, text string")
    got = positions.proximity(positions.build_index(rows), ["X", "y"], 5).collect()
    assert {(r.doc_id, r.start, r.end) for r in got} == {(1, 0, 5), (3, 0, 2)}


def test_embedding_links_are_exact_for_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(itq, "TILE", 8)
    draw = np.random.default_rng(6)
    base = draw.normal(size=(40, 32))
    rows = [(k, (base[k % 40] + draw.normal(size=32) * 0.06).tolist(), k % 40 % 2) for k in range(200)]
    rows += [(200 + k, base[0].tolist(), 0) for k in range(30)] + [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] * 32, 1), (903, base[0].tolist(), None), (904, [1.0], 0)]
    got = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    sound = [r for r in rows if r[0] < 900]
    x = np.array([r[1] for r in sound])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.93) & (np.array([r[2] for r in sound])[:, None] == np.array([r[2] for r in sound])[None, :])
    np.fill_diagonal(link, False)
    assert {k: got[r[0]].n_links for k, r in enumerate(sound)} == {k: int(link[k].sum()) for k in range(len(sound))}
    roots = simhash._local_components(len(sound), *np.nonzero(link))
    assert [got[r[0]].component_id for r in sound] == [sound[k][0] for k in roots]
    assert all(got[k].n_links == 0 and got[k].kept for k in range(900, 905))
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int")).count() == 0


def test_licence_rules(spark, docs, none):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software\nand associated documentation files (the \"Software\"),\nx.\nMIT License"
    rows = spark.createDataFrame([(1, "MIT License. " + text), (2, text), (3, "not MIT License here")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert got[1].licenses == ["MIT"] and got[1].sentences[:2] == ["mit-name", "mit-grant"]
    assert got[2].licenses == [] and got[2].sentences == ["mit-grant", "mit-name"]
    assert got[3].sentences == []
    assert {r.doc_id: r.licenses for r in licenses.scan(docs).collect()}[7] == ["Apache-2.0"]
    assert licenses.scan(none).count() == 0


def test_classifiers_learn_and_take_odd_rows(spark, docs, none):
    draw = np.random.default_rng(8)
    good, bad = "calm words in a plain line of text".split(), "### $$$ | %%%".split()
    rows, marks = [], []
    for k in range(400):
        flag = k % 4 == 0
        words = draw.choice(good, 30).tolist() + (["idiot"] if flag else []) + (draw.choice(bad, 20).tolist() if k % 3 == 0 else [])
        rows.append((k, " ".join(words)))
        marks.append((k, int(k % 3 != 0), int(flag)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([*marks, (9999, 1, 1), (None, None, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(table, labels.where("doc_id % 5 != 0"))
    scores = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert all((scores[k] >= 0.5) == bool(toxic) for k, _, toxic in marks if k % 5 == 0)
    described = quality.described(table)
    fitted = quality.fit(described, labels.where("doc_id % 5 != 0"), F.col("doc_id") % 5 == 4)
    scores = {r.id: r.score for r in quality.score(described, fitted).collect()}
    assert np.mean([(scores[k] >= 0.5) == bool(q) for k, q, _ in marks if k % 5 == 0]) > 0.95
    assert all(0 <= r.s <= 1 for r in toxicity.score(docs, model, score_col="s").collect())
    assert all(0 <= r.score <= 1 for r in quality.score(quality.described(docs), fitted).collect())
    empty = labels.where("false")
    assert {r.s for r in toxicity.score(docs, toxicity.fit(docs, empty), score_col="s").collect()} == {0.5}
    assert {r.score for r in quality.score(quality.described(docs), quality.fit(quality.described(docs), empty, F.lit(True))).collect()} == {0.5}
    assert toxicity.score(none, model, score_col="s").count() == 0 and quality.described(none).count() == 0


def test_isotonic_pools():
    edges, shares = quality.isotonic(np.array([0, 3, 1, 0, 4.0]), np.array([4, 4, 4, 0, 4.0]))
    assert shares.tolist() == [0, 0.5, 1] and edges.tolist() == [1, 4]


def test_pipeline_stages_take_odd_rows(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    duckdb.sql("select 1 as item_id, 'alpha beta gamma delta epsilon zeta eta theta iota kappa' as text").write_parquet(f"{tmp_path}/benchmark.parquet")
    duckdb.sql("select 1::bigint as doc_id, 1 as quality, 0 as toxic").write_parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in pipeline.STAGES:
        before, now = now, stage(spark, now, str(tmp_path))
        if name != "token_ids":
            assert now.columns == before.columns
        if name == "near_duplicates":
            # One of the three copies, one of the texts without words.
            assert sorted(str(r.doc_id) for r in now.collect()) == ["1", "2", "6", "7", "None"]
        if name == "decontamination":
            assert 1 not in [r.doc_id for r in now.collect()]
    assert now.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_near_copies_are_the_exact_components(spark, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(pipeline.jaccard, "SLICE_ROWS", 4)
    draw = np.random.default_rng(12)
    texts = []
    for g in range(12):
        base = [f"w{g}x{k}" for k in range(400)]
        for share in (0.0, 0.003, 0.01, 0.015, 0.03, 0.04, 0.05, 0.06):
            texts.append(" ".join(f"n{draw.integers(10**9)}" if draw.random() < share else w for w in base))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])
    label = simhash._local_components(len(texts), *np.nonzero(near >= 0.8))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    candidates = simhash.fingerprints(rows, shingle=5, wide=True)
    coarse = {r.doc_id: r.component_id for r in simhash.component_ids(candidates, radius=22, wide=True).collect()}
    kept = {r.doc_id for r in pipeline.near_duplicates(spark, rows, "").collect()}
    # The prints alone drop texts without a neighbour at 0.8, and lose no link of these groups.
    assert any(coarse[k] != k and not (np.delete(near[k], k) >= 0.8).any() for k in range(len(texts)))
    assert all(coarse[i] == coarse[j] for i, j in zip(*np.nonzero(near >= 0.8), strict=True))
    assert kept == set(label.tolist())


def test_wide_crowded_shards_keep_every_pair_that_meets(spark, monkeypatch):
    draw = np.random.default_rng(14)
    base = [int(x) for x in draw.integers(0, 2**63, 2)]
    # Variants 16 to 26 bits from one hot print, and prints that share the first half alone.
    rows = {(base[0], base[1])}
    for _ in range(150):
        flips = draw.choice(126, int(draw.integers(8, 14)), replace=False)
        rows.add(tuple(base[h] ^ sum(1 << int(b % 63) for b in flips if b // 63 == h) for h in (0, 1)))
    far = int(draw.integers(0, 2**63))
    rows = sorted(rows | {(5, far), (5, far ^ 0b111), (5, far ^ (2**40 - 1))})
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id bigint, fp bigint, fp2 bigint")
    v = np.array(rows, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]).sum(axis=2) <= 18
    blocks = [sum(1 << b for b in range(i, 64, 8)) for i in range(8)]
    agree = sum(((v[:, None] ^ v[None, :]) & np.uint64(m) == 0).astype(int) for m in blocks) >= 2
    want = simhash._local_components(len(v), *np.nonzero(near & agree.any(axis=2))).tolist()
    for most in (8192, 16):
        monkeypatch.setattr(simhash, "SHARD_ROWS", most)
        got = {r.doc_id: r.component_id for r in simhash.component_ids(table, radius=18, wide=True).collect()}
        assert [got[k] for k in range(len(rows))] == want
    assert len({want[rows.index((5, x))] for x in (far, far ^ 0b111, far ^ (2**40 - 1))}) == 2


GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
GPL = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
CANONICAL = {
    "MIT": f"Copyright (c) 2020 Someone\n\n{GRANT}\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "BSD-2-Clause": f"Copyright (c) 2020, Someone\n\n{BSD}\n\n{AS_IS}",
    "BSD-3-Clause": f"Copyright (c) 2020, Someone\n\n{BSD}\n\n{NAMES}\n\n{AS_IS}",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": GPL.format(":", ",", 3),
    "GPL-2.0": GPL.format(";", ";", 2),
}


def test_canonical_licences_at_any_width(spark):
    texts = []
    for name, text in CANONICAL.items():
        wraps = ["\n".join(textwrap.fill(x, w) for x in text.split("\n")) for w in (30, 60, 72, 79, 100)]
        texts += [(name, x) for x in (text, " ".join(text.split()), *wraps)]
    texts += [("BSD-3-Clause,BSD-2-Clause", CANONICAL[a] + "\n" + CANONICAL[b]) for a, b in (("BSD-2-Clause", "BSD-3-Clause"), ("BSD-3-Clause", "BSD-2-Clause"))]
    texts += [("GPL-3.0", "Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n"), ("", "not released under the MIT License.")]
    rows = spark.createDataFrame([(k, x) for k, (_, x) in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: ",".join(r.licenses) for r in licenses.scan(rows).collect()}
    assert got == {k: name for k, (name, _) in enumerate(texts)}


def test_repeated_items_count_once_in_any_number_of_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a b c d e f g")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "a b c"), (7, "d e f"), (8, "e f g")], "item_id bigint, text string")
    for most in (10**6, 3):
        monkeypatch.setattr(positions, "QUERY_WORDS", most)
        got = positions.phrase_spans(positions.build_index(rows), items, window=3).collect()
        assert [sorted(r["items"]) for r in got] == [["7", "8"]]


def test_embeddings_of_every_length_are_searched(spark):
    draw = np.random.default_rng(15)
    long, short = draw.normal(size=(6, 32)), draw.normal(size=(4, 16))
    rows = [(k, long[k % 6].tolist(), 0) for k in range(12)] + [(100 + k, (short[k % 4] * (1 + k)).tolist(), 0) for k in range(8)]
    got = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert {k: (r.n_links, r.component_id) for k, r in got.items()} == {k: (1, k % 6 if k < 100 else 100 + k % 4) for k, _, _ in rows}
