"""Operators against brute force and on odd inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import (
    components, exact_dedup, lattice_lm, licenses, mixing, near_join, packing, quality, repeats, toxicity, vptree,
)
from eventloom.llm import textbytes as tb
from eventloom.llm.common import LOWER, UPPER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CASE = str.maketrans(UPPER, LOWER)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    syllables = "an the of re tion is er ou ch ß é ñ lo mi".split()
    vocab = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        if i % 6 == 5:
            text = rows[-2][1]
        elif i % 6 == 4:
            words = rows[-1][1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        else:
            text = " ".join(rng.choices(vocab, k=rng.randint(3, 120)))
        rows.append((i, text, "en", f"src{i % 4}" if i % 7 else None, len(text)))
    shared = " ".join(vocab[:40])
    rows += [(n, shared + " one", "en", "b", 1), (n + 1, "two " + shared, "de", "b", 1), (n + 2, None, None, None, None), (n + 3, "", "en", "b", 0), (n + 4, " \t\n", "en", "c", 3), (n + 5, "A b", "en", "c", 3), (n + 6, "a B", "en", "c", 3), (n + 7, "x" * 3000, "en", "c", 3000)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_license_scan(spark):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    )
    parts = mit.split("\n")
    cases = [
        (1, "Text.\nReleased under the MIT License", "MIT", "permissive", 1),
        (2, mit, "MIT", "permissive", 3),
        (3, "\n".join(reversed(parts)), "", "none", 3),
        (4, "Licensed under CC BY-NC 4.0. And Licensed under the Apache License, Version 2.0.", "CC-BY-NC-4.0", "restricted", 1),
        (5, None, "", "none", 0), (6, "", "", "none", 0), (7, "a licence of sorts", "", "none", 0),
        (8, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License.", "MIT;CC-BY-NC-4.0", "restricted", 3),
    ]
    df = spark.createDataFrame([(i, t, "mine") for i, t, *_ in cases], "doc_id long, text string, licenses string")
    got = {r.doc_id: (r.licenses, r.license_class, r.n_known) for r in licenses.scan(df).collect()}
    assert got == {i: tuple(x) for i, _, *x in cases}
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_scan_of_usual_forms(spark):
    mit = """MIT License

Copyright (c) 2020 Someone

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
    gpl = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
    bsd = """Copyright (c) 2020, Someone
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.

{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL"""
    third = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License."""

    def comment(text, sign):
        return "\n".join(sign + line for line in text.split("\n"))

    cases = [
        (mit, "MIT", 3), (mit.replace("\n", "\r\n"), "MIT", 3), ("/*\n" + comment(mit, " * ") + "\n */\nint x;", "MIT", 3), (comment(mit, "! "), "MIT", 3),
        (gpl, "GPL-3.0", 2), (comment(gpl, "# "), "GPL-3.0", 2), (gpl.replace("software:", "software;"), "GPL-3.0", 2),
        (bsd.format(""), "BSD-2-Clause", 2), (comment(bsd.format(third), "// "), "BSD-3-Clause;BSD-2-Clause", 3), (comment(apache, "// "), "Apache-2.0", 2),
        ("// SPDX-License-Identifier: MIT\nint x;", "MIT", 1), ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0", 1), ("# SPDX-License-Identifier:CC0-1.0", "CC0-1.0", 1),
        ("# SPDX-License-Identifier: GPL-3.0-only\r\n", "GPL-3.0", 1), ("<!-- SPDX-License-Identifier: GPL-3.0-or-later -->", "GPL-3.0", 1),
        ("# This work is dedicated to the public\n# domain under CC0 1.0", "CC0-1.0", 1), ("A line\nLicensed under CC BY 4.0\nAnother line", "CC-BY-4.0", 1),
        ("Licensed under the Apache License, Version 2.0\nthe License", "Apache-2.0", 2),
        ("SPDX-License-Identifier: MITX", "", 0), ("Licensed under CC BY\n\n4.0", "", 0), ("Licensed under. CC BY 4.0", "", 0), ("Not licensed under CC BY 4.0", "", 0),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.n_known) for r in licenses.scan(df).collect()}
    assert got == {i: tuple(x) for i, (_, *x) in enumerate(cases)}


def test_exact_dedup(spark, docs, rows):
    many = spark.createDataFrame([(1000 + i, "Hot Text" if i % 2 else "hOT tEXT", "en", "s", 8) for i in range(40)] + [(5, rows[5][1], "en", "s", 1), (None, "only", "en", "s", 4)], DOCS)
    df = docs.unionByName(many).withColumn("keep_id", F.lit("mine"))
    marked = exact_dedup.mark_duplicates(df, keep_text=False).collect()
    groups = {}
    for i, t, *_ in [tuple(r)[:5] for r in df.collect()]:
        groups.setdefault((t or "").translate(CASE), []).append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(marked) == df.count()
    for r in marked:
        ids = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (max((x for x in ids if x is not None), default=None), len(ids))
    kept = Counter(r.text_sha256 for r in marked if r.kept)
    assert set(kept) == set(by_sha) and set(kept.values()) == {1}
    left = exact_dedup.drop_duplicates(df)
    assert left.columns == df.columns and left.count() == len(groups)
    assert exact_dedup.mark_duplicates(empty(spark)).count() == 0


def test_language_model(spark, docs, rows):
    out = {r.doc_id: r for r in lattice_lm.score_documents(docs).collect()}
    counts, ends = Counter(), 0
    tokens = {i: WORD.findall((t or "").translate(CASE)) for i, t, *_ in rows}
    for i, words in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(words)
            ends += 1
    total = sum(counts.values()) + ends
    size = math.log10(total + 0.5 * (len(counts) + 2))
    for i, words in tokens.items():
        base = sum(math.log10(counts[w] + 0.5) - size for w in words) + math.log10(ends + 0.5) - size
        r = out[i]
        assert r.base_score == pytest.approx(base) and r.train_tokens == total and r.n_tokens == len(words) + 1
        assert r.n_known == sum(counts[w] > 0 for w in words) + 1 and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert math.isfinite(r.word_score) and r.word_score < 0
    # the score by brute force, from weights learned alike: every split of every word
    lattice = lattice_lm.Lattice(lattice_lm.pieces())
    words = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, seen long")
    lattice_lm.learn(words, lattice, total, len(counts) + 1)
    weight = {}
    for piece, w in zip(lattice_lm.pieces(), lattice.weights):
        weight[piece] = math.exp(w)

    @functools.cache
    def total_of(word):
        return 1.0 if not word else sum(weight.get(word[:k], 0.0) * total_of(word[k:]) for k in range(1, len(word) + 1))

    for i, words in tokens.items():
        if sum(map(len, words)) < 600:
            want = sum(math.log10(total_of(b" " + w.encode())) + lattice.stop / math.log(10) + math.log10(1 - ends / total) for w in words) + math.log10(ends / total)
            assert out[i].score == pytest.approx(want)
    assert lattice_lm.score_documents(empty(spark)).count() == 0


def test_lattice_sums_all_segmentations():
    lattice = lattice_lm.Lattice([b" a", b"b", b"ab", b" ab", b"c", b"bc", *[bytes([x]) for x in range(256) if x not in b"bc"]])

    def total(word, start=0):
        if start == len(word):
            return 1.0
        pieces = [b" a", b"b", b"ab", b" ab", b"c", b"bc", *[bytes([x]) for x in range(256) if x not in b"bc"]]
        return sum(math.exp(lattice.weights[k]) * total(word, start + len(p)) for k, p in enumerate(pieces) if word.startswith(p, start))

    for word in ("abc", "aabbc", "zabc"):
        for some, block in lattice_lm.blocks_of([word]):
            assert lattice.forward(block)[0][-1][0] == pytest.approx(math.log(total(b" " + word.encode())))
            assert lattice.expect(block, np.ones(1)).sum() >= 1


def test_vantage_trees(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 8))
    m = (centres[rng.integers(0, 5, 900)] + rng.normal(scale=0.3, size=(900, 8))).astype(np.float32)
    m[50:80] = m[50]
    ids = np.arange(900)
    rows = [(int(i), [float(x) for x in v], "mine") for i, v in zip(ids, m)]
    rows += [(2000, None, ""), (2001, [0.0] * 8, ""), (2002, [float("nan")] * 8, ""), (2003, [1.0, None] * 4, ""), (2004, [1.0] * 3, ""), (None, [1.0] * 8, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    asked = df.filter("vec_id % 50 = 0")
    d = np.sqrt(((m[:, None].astype(float) - m[None].astype(float)) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)

    def found(factor):
        out = {}
        for r in vptree.nearest(df, asked, factor=factor, shard_rows=300, leaf_rows=16).collect():
            out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}

    exact = found(1.0)
    assert set(exact) == set(range(0, 900, 50))
    hits = 0
    for q, got in exact.items():
        best = np.lexsort((ids, d[q]))[:10]
        assert [i for i, _ in got] == best.tolist() and np.allclose([s for _, s in got], d[q][best], atol=0, rtol=1e-12)
    for q, got in found(vptree.FACTOR).items():
        hits += len({i for i, _ in got} & {i for i, _ in exact[q]})
    assert hits >= 0.9 * 10 * len(exact)
    assert vptree.nearest(df.limit(0), asked.limit(0)).count() == 0
    tree = vptree.VantageTree(ids, m.astype(float), 16)
    assert tree.search(ids[:20], m[:20].astype(float), 10, 1.0)[2] < 20 * len(tree.leaves)


def test_encoders_agree(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.encoder()
    odd = ["<|endoftext|> a <|endoftext|>b", "  two  spaces\n\n\ttab ", "naïve café ßÑ 123,456.7 don't I'LL", "日本語 テキスト 🎭🎭", " x y​z", "a" * 5000, "\u0001\u007f\u0085"]
    for text in [t or "" for _, t, *_ in rows] + odd:
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids, text


def test_packing(spark, docs, rows):
    encode = packing.encoder()
    long = spark.createDataFrame([(900, "one two three four " * 2000, "en", "s", 1)], DOCS)
    out = packing.pack_documents(docs.unionByName(long), size=256, pool_tokens=3000).collect()
    texts = {i: t for i, t, *_ in rows} | {900: "one two three four " * 2000}
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for i, mine in pieces.items():
        ids = np.append(encode(texts[i] or ""), 0).astype("<u4")
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for mine in sequences.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack_documents(empty(spark)).count() == 0


def test_best_fit_decreasing_is_the_textbook_one():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 400)
    window, offset, opened = packing.best_fit_decreasing(lengths, 100)
    rooms = []
    for need in sorted(lengths.tolist(), reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= need]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= need
        else:
            rooms.append(100 - need)
    used = np.bincount(window, lengths, opened)
    assert opened == len(rooms) and sorted(used.tolist()) == sorted(100 - r for r in rooms)


def shingles(text):
    words = WORD.findall((text or "").translate(CASE))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def linked_groups(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_jaccard_join(spark, docs, rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    want = linked_groups(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_join.near_groups(docs.withColumn("n", F.lit(1)).withColumn("sid", F.lit("x"))).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    kept = near_join.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in sets if want[i] == i}
    assert near_join.near_groups(empty(spark)).count() == 0


def test_jaccard_join_of_a_cloud(spark):
    """Variants of one text, some linked only through others, at sizes around the class limits."""
    rng = random.Random(5)
    rows = []
    for size in (6, 7, 11, 12, 30, 60, 150):
        base = [f"w{size}x{i}" for i in range(size)]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                words[rng.randrange(size)] = f"v{rng.random()}"
            rows.append((len(rows), " ".join(words[: rng.randint(max(5, size - 2), size)]), "en", "s", 0))
    sets = {i: shingles(t) for i, t, *_ in rows}
    want = linked_groups(sets)
    got = {r.doc_id: r.component_id for r in near_join.near_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want


@pytest.mark.parametrize("across", [False, True])
def test_region_join_by_pivots(across):
    """Clouds around far centres, and one cloud that no pivot parts: the forest has the components of all links."""
    rng = np.random.default_rng(11)

    def fresh(n):
        return rng.integers(0, 2**63, n, dtype=np.uint64)

    sets = []
    for size, members, most in ((60, 120, 12), (70, 90, 16), (300, 80, 60), (45, 150, 9), (5, 30, 1)):
        core = fresh(size)
        for _ in range(members):
            keep = rng.permutation(size)[: size - rng.integers(0, most + 1)]
            sets.append(np.unique(np.concatenate([core[keep], fresh(rng.integers(0, most + 1))])))
    common = fresh(40)
    sets += [np.unique(np.concatenate([common, fresh(40)])) for _ in range(100)]
    n = len(sets)
    block = np.arange(n) % 2
    part = near_join.Part(np.arange(n), np.arange(n), block, [x.tobytes() for x in sets], across)
    part.join(np.arange(n))
    as_sets = [set(x.tolist()) for x in sets]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if not across or block[a] != block[b]:
                both = len(as_sets[a] & as_sets[b])
                if 100 * both >= 80 * len(as_sets[a] | as_sets[b]):
                    root[find(a)] = find(b)
    groups = len({find(x) for x in range(n)})
    assert len(part.links) <= n - groups + (n if across else 0)
    for a, b in part.links:
        assert 100 * len(as_sets[a] & as_sets[b]) >= 80 * len(as_sets[a] | as_sets[b])
    made = list(range(n))
    for a, b in part.links:
        made = [made[a] if x == made[b] else x for x in made]
    if across:  # links inside a block may show too, never fewer
        assert all(made[a] == made[b] for a in range(n) for b in range(a) if find(a) == find(b))
    else:
        assert len(part.links) == n - groups and len(set(made)) == groups


def test_jaccard_join_of_a_common_passage(spark):
    """Very many documents that share one long passage and do not link, and a few that do."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"o{rng.random()}" for _ in range(60)), "en", "s", 0) for i in range(2000)]
    rows += [(3000 + i, rows[i * 7][1] + " more", "en", "s", 0) for i in range(5)]
    got = {r.doc_id: r.component_id for r in near_join.near_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: (i - 3000) * 7 if i >= 3000 else i for i, *_ in rows}


def test_jaccard_join_in_small_blocks(spark, docs, rows, monkeypatch):
    """Cells cut into blocks, and joins without broadcast, give the same."""
    want = linked_groups({i: shingles(t) for i, t, *_ in rows})
    monkeypatch.setattr(near_join, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(near_join, "BLOCK_SHINGLES", 200)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.component_id for r in near_join.near_groups(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == want


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40, 700):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(1, int(n * 0.9))], rng.integers(0, 2**63, n // 20, dtype=np.uint64)]))
        x, y = near_join.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        size = min(len(x), len(y))
        apart = np.bitwise_count(near_join.fold_sketch(np.frombuffer(x, np.uint8), size) ^ near_join.fold_sketch(np.frombuffer(y, np.uint8), size)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: find(v) for v in root if find(v) != v}


def test_components_of_odd_edges(spark):
    from eventloom.llm.components import components

    edges = spark.createDataFrame([(1, 1, "x"), (5, 3, "x"), (3, 5, "x"), (5, 3, None), (None, 3, "x"), (7, None, "x")], "u long, v long, comp string")
    assert sorted(map(tuple, components(edges).collect())) == [(5, 3)]
    assert components(edges.limit(0)).isEmpty()


def test_quality_and_toxicity(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices(["an", "re", "tion", "the", "of"], k=rng.randint(1, 3))) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic, good = i % 5 == 0, i % 3 != 0
        text = [rng.choice(words) for _ in range(40)]
        if toxic:
            text[rng.randrange(40)] = rng.choice(["idiot", "scumbags", "scum"])
        rows.append((i, " ".join(text) if good else " | ".join(w.upper() + "!!" for w in text), "en", "s", 1, 0.5))
        labels.append((i, int(good), int(toxic)))
    docs = spark.createDataFrame(rows + [(1000, None, None, None, None, 0.5), (1001, "", "en", "s", 0, 0.5)], DOCS + ", score double")
    marks = spark.createDataFrame(labels + [(5000, None, None), (5001, 1, 1)], "doc_id long, quality int, toxic int")
    for module, label in ((toxicity, 2), (quality, 1)):
        out = {r.doc_id: r for r in module.score_documents(docs, module.fit(docs, marks)).collect()}
        assert len(out) == 602 and all(0 <= r.score <= 1 for r in out.values())
        held = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 0]
        right = sum(out[x[0]].predicted == x[label] for x in held)
        assert right >= 0.95 * len(held), (module.__name__, right, len(held))
        none = module.score_documents(docs, module.fit(docs, marks.limit(0)))
        assert none.count() == 602
        assert module.score_documents(docs.limit(0), module.fit(docs.limit(0), marks)).count() == 0


def test_repeated_strings(spark, docs, rows):
    line = "this line is in many documents and is well over a hundred bytes long so that it must go when it comes again, ünïcode too. "
    more = [(200 + i, f"{i} start {line * (1 + i % 2)} end {i}", "en", "s", 1) for i in range(12)] + [(300, "ab" * 300, "en", "s", 1), (300, "ab" * 300, "en", "s", 1)]
    df = docs.unionByName(spark.createDataFrame(more, DOCS)).repartition(3)
    want, seen = {}, set()
    for i, t, *_ in sorted({(r[0], r[1] or "") for r in rows + more}):
        data = t.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            part = data[k : k + 100]
            if part in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(part)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        want[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    out = repeats.repeats(df).collect()
    assert len(out) == df.count()
    for r in out:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert repeats.repeats(empty(spark)).count() == 0


def test_mixing(spark, docs, rows):
    plan = {}
    out = {r.doc_id: r for r in mixing.documents_in_mix(docs.withColumn("rank", F.lit("mine"))).collect()}
    sizes = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    for i, _, _, s, _ in rows:
        plan.setdefault(s, []).append(i)
    names = sorted(plan, key=lambda s: (s is None, s or ""))
    totals = {s: sum(sizes[i] for i in plan[s]) for s in names}
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want, share, open_ = {}, 1.5 * sum(totals.values()), set(names)
    while True:
        level = share / sum(weights[s] for s in open_) if open_ else 0
        full = {s for s in open_ if weights[s] * level >= 2 * totals[s]}
        if not full:
            break
        for s in full:
            want[s] = 2.0 * totals[s]
            share -= want[s]
        open_ -= full
    want |= {s: weights[s] * level for s in open_}
    for s in names:
        taken = sum(out[i].taken for i in plan[s])
        assert abs(taken - want[s]) <= 1
        for i in plan[s]:
            r = out[i]
            assert (r.size, r.source_size) == (sizes[i], totals[s]) and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
    again = {r.doc_id: r.taken for r in mixing.documents_in_mix(docs.repartition(2)).collect()}
    assert again == {i: r.taken for i, r in out.items()}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    counted = Counter()
    for r in mixed.collect():
        counted[r.doc_id] += len(WORD.findall(r.text))
    assert all(counted[i] == out[i].taken for i in out)
    assert mixing.documents_in_mix(empty(spark)).count() == 0


def test_mixing_shards_cover_all_draws(spark, docs):
    sizes = mixing.sizes_of(docs, "doc_id", "source", "text")
    plan = mixing.source_plan(sizes)
    draws = mixing.draw_blocks(plan).groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("epoch", "block").alias("d"), F.sum("words").alias("w"))
    for r in plan.filter("draws > 0").join(draws, "rank").collect():
        assert r.n == r.draws == r.d and abs(r.w - r.target) <= 1


def test_mix_shards_follow_the_draws(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"d{i}w{j}" for j in range(rng.choice([1, 30, 400, 3000, 9000]))]
        rows.append((i, "\n " + "".join(w + rng.choice([" ", "  ", "\t", "\n\n"]) for w in words), "en", f"s{i % 3}", 7, "mine"))
    df = spark.createDataFrame(rows, DOCS + ", other string").repartition(3)
    out = mixing.mix_shards(df).collect()
    draws = mixing.draw_blocks(mixing.source_plan(mixing.sizes_of(df, "doc_id", "source", "text"))).groupBy("rank", "shard").agg(F.sum("words").alias("n")).collect()
    want, got, texts, used = {(f"s{r.rank}", r.shard): r.n for r in draws}, Counter(), {r[0]: r[1] for r in rows}, Counter()
    for r in out:
        assert r.text in texts[r.doc_id] and r.other == "mine" and r.n_chars == (7 if r.text == texts[r.doc_id] else len(r.text))
        found = WORD.findall(r.text)
        got[r.source, r.shard] += len(found)
        used.update(found)
    assert got == want and len({shard for _, shard in want}) > 1
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.documents_in_mix(df).collect()}
    for i, (size, n) in taken.items():
        times = [used[f"d{i}w{j}"] for j in range(size)]
        assert sum(times) == n and max(times) <= 2
    assert mixing.mix_documents(df).columns == df.columns
    assert mixing.mix_shards(empty(spark)).count() == 0


def test_cut_texts_are_parts_of_the_text(spark):
    text = "".join(f"w{i}" + ("\n\t" if i % 3 else "  ") for i in range(6000))
    df = spark.createDataFrame([(1, text, "en", "b", len(text)), (2, "b " * 9000, "en", "a", 18000)], DOCS)
    parts = [r.text for r in mixing.mix_documents(df).collect() if r.doc_id == 1]
    assert parts and all(p in text and p != text for p in parts)


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 1000, 4096):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit(1)).alias("x"))
        assert {r.x for r in df.collect()} == set(range(n))


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["ab cd", None, "", "x\ty z", "ab"]
    for low, high, data, offsets in tb.chunks(pa.array(texts)):
        starts, ends = tb.words(data, offsets)
        assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["ab", "cd", "x", "y z", "ab"]
        h = tb.hashes(tb.prefix_hash(data), starts, ends)
        assert h[0] == h[4] == tb.hash_of("ab") and len(set(h.tolist())) == 4
