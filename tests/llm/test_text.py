import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import licenses, packing, syncmers, toxicity, transcripts, warc
from chronolith.llm.bpe import Encoder, bpe_round_trip
from chronolith.llm.common import Scratch

HARD = ["", " ", "a", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "he's we'll I'D", "  \n\t x  ", "日本語 テスト 😀👩‍👩‍👧", "\x00\x01\x7f\x85", "ſ'ſ ͏ é", "aaaa" * 200, " " * 130, "http://a.b/c?d=e&f=%20", "1234567890 ½ ²", "ǅ ﬀ İ"]


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_bpe_equals_the_tokenizers_library():
    path, t = _tokenizer()
    e = Encoder(path)
    rng = random.Random(3)
    texts = HARD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x2FF), rng.randrange(0x1F300, 0x1F600)])) for _ in range(80)) for _ in range(150)]
    texts += [" ".join("".join(rng.choice(["th", "er", "in", "tion", "Q", "zz", "://", "é"]) for _ in range(rng.randrange(1, 12))) for _ in range(30)) for _ in range(150)]
    for x in texts:
        ids = np.frombuffer(e.encode(x), "<u4").tolist()
        assert ids == t.encode(x, add_special_tokens=False).ids, repr(x)
        assert e.decode(e.encode(x)) == t.decode(ids, skip_special_tokens=False)


def test_bpe_round_trip(spark):
    path, t = _tokenizer()
    rows = [(i, x) for i, x in enumerate(HARD)] + [(99, None), (99, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("ids", F.lit(0))
    got = bpe_round_trip(df, path).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = t.encode(HARD[r.doc_id] if r.doc_id < 99 else "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_round_trip(df.limit(0), path).count() == 0


@pytest.mark.parametrize("stretch", [3, 8000])
def test_fingerprints_and_the_next_document(spark, monkeypatch, stretch):
    monkeypatch.setattr(syncmers, "STRETCH_ROWS", stretch)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefg hi😀") for _ in range(n)) for n in (0, 1, 5, 11, 12, 13, 80, 300, 3000)]
    rows = list(enumerate(texts)) + [(20, texts[7]), (21, texts[7]), (22, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("o", F.lit(3)).repartition(3)
    got = {r.doc_id: r for r in syncmers.fingerprints(df).collect()}
    assert sorted(got) == [i for i, _ in rows]
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, following = t or "", following or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == syncmers.render(syncmers.sketch(t)) and r.edited_fingerprint == syncmers.render(syncmers.sketch(edited))
        assert r.near_next == syncmers.likeness(syncmers.parse(r.fingerprint), syncmers.sketch(following))
    assert got[20].near_next == 1.0 and got[20].fingerprint == got[21].fingerprint
    assert 0.5 < got[8].near_edited < 0.85 and got[7].near_next < 0.1
    assert syncmers.fingerprints(df.limit(0)).count() == 0


def test_texts_without_syncmers_are_like_themselves_only():
    rng = random.Random(19)
    bare = [t for t in ("".join(rng.choice("abcdefgh ij") for _ in range(rng.randrange(1, 18))) for _ in range(400)) if len(syncmers._syncmers(syncmers._codes(t), syncmers.K, syncmers.S)[1]) == 0]
    assert any(len(t) >= syncmers.K for t in bare) and len(syncmers.sketch("")[0]) == 0
    for a, b in zip(bare, bare[1:], strict=False):
        x, y = syncmers.sketch(a), syncmers.sketch(b)
        assert len(x[0]) == 1 and syncmers.likeness(x, x) == 1.0 and syncmers.likeness(x, y) == float(a == b) and syncmers.likeness(x, syncmers.sketch("")) == 0.0


def test_long_texts_in_chunks_have_the_same_syncmers(monkeypatch):
    rng = random.Random(20)
    for n in (1, 11, 12, 99, 100, 101, 700):
        text = "".join(rng.choice("abcdefg hi") for _ in range(n))
        whole = syncmers.syncmers(text)
        monkeypatch.setattr(syncmers, "CHUNK", 100)
        for x, y in zip(whole, syncmers.syncmers(text), strict=True):
            assert x.tolist() == y.tolist()
        monkeypatch.undo()


def test_likeness_is_the_longest_common_order_of_anchors():
    rng = random.Random(21)
    for _ in range(40):  # few different anchors, with repeats; brute force over the n-th places of each
        texts = []
        for _ in range(2):
            hashes = np.sort(np.array([rng.randrange(5) for _ in range(rng.randrange(1, 9))], np.uint64))
            places = np.array(rng.sample(range(50), len(hashes)))
            order = np.lexsort((places, hashes))
            texts.append((hashes[order], places[order]))
        pairs = []
        for h in range(5):
            a, b = (sorted(p[x == h].tolist()) for x, p in texts)
            pairs += list(zip(a, b, strict=False))
        best = max(bin(m).count("1") for m in range(1 << len(pairs)) if all((a < c) == (b < d) for (a, b) in [p for i, p in enumerate(pairs) if m >> i & 1] for (c, d) in [p for i, p in enumerate(pairs) if m >> i & 1] if (a, b) != (c, d)))
        assert syncmers.likeness(*texts) == 2 * best / sum(len(h) for h, _ in texts)


def test_syncmers_are_free_of_context():
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefghijk ") for _ in range(400))
    alone = {(int(h), int(p)) for h, p in zip(*syncmers.syncmers(passage), strict=True)}
    inside = {(int(h), int(p) - 7) for h, p in zip(*syncmers.syncmers("prefix " + passage + " suffix"), strict=True)}
    assert alone <= inside
    grams = {passage[p : p + syncmers.K] for _, p in alone}
    for i in range(len(passage) - syncmers.K + 1):  # the definition, k-mer by k-mer
        inner = [int(syncmers._grams(np.array([ord(c) + 1 for c in passage[i + j : i + j + syncmers.S]], np.uint64), syncmers.S)[0]) for j in range(syncmers.K - syncmers.S + 1)]
        assert (passage[i : i + syncmers.K] in grams) == (min(inner) in (inner[0], inner[-1]))


def test_fingerprints_keep_all_anchors():
    rng = random.Random(18)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    for n in (14_000, 100_000):
        t = text(n)
        hashes, places = syncmers.syncmers(t)
        assert sorted(zip((hashes >> np.uint64(32)).tolist(), places.tolist(), strict=True)) == list(zip(*(x.tolist() for x in syncmers.sketch(t)), strict=True))
        for x, y in zip(syncmers.parse(syncmers.render(syncmers.sketch(t))), syncmers.sketch(t), strict=True):
            assert (x == y).all()
        edited = t[: n // 2] + text(60) + t[n // 2 + 60 :]
        assert 1 - 200 / n < syncmers.likeness(syncmers.sketch(t), syncmers.sketch(edited)) < 1
        assert syncmers.likeness(syncmers.sketch(t), syncmers.sketch(t)) == 1.0
    passage = text(400)
    a, b = (syncmers.sketch(text(40_000) + passage + text(59_600)) for _ in range(2))
    own = set(syncmers.sketch(passage)[0].tolist())
    assert len(own) > 50 and own <= set(a[0].tolist()) & set(b[0].tolist())
    twice = syncmers.sketch(passage + passage)
    assert np.bincount(np.unique(twice[0], return_counts=True)[1])[2] >= len(own)


def test_toxicity_learns_sentences_from_documents(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "ru"]) for _ in range(rng.randrange(2, 4)))
    docs, labels = [], []
    for i in range(600):
        sentences = [" ".join(word() for _ in range(8)) for _ in range(rng.randrange(1, 9))]
        toxic = i % 5 == 0
        if toxic:
            sentences[rng.randrange(len(sentences))] += rng.choice([" scoundrel", " VILLAIN"])
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic if rng.random() > 0.03 else not toxic)))
    docs += [(1000, None), (1001, ""), (1002, "x " * 20000), (1000, "villain"), (None, "a villain.")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert held and all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    texts = dict(docs[:600])
    for r in held:
        for s in r.offending:
            assert any(w in texts[r.doc_id][s.start : s.end].lower() for w in ("scoundrel", "villain"))
    assert all((r.score >= 0.7) == (r.predicted == 1) for r in got)
    assert {r.predicted for r in got if r.doc_id in (1001, 1002)} == {0} and {r.predicted for r in got if r.doc_id is None} == {1}
    clean = toxicity.without_toxic(df, lab)
    assert clean.columns == df.columns and clean.count() == sum(r.predicted == 0 for r in got)
    none = toxicity.toxicity(df, lab.where("toxic = 0")).agg(F.max("score")).first()[0]
    assert none == 0.0


def _noisy_or(weights, leak, text):
    left = 1 - 1 / (1 + np.exp(-leak))
    for s in toxicity.SENTENCE.findall(text.lower()):
        z = toxicity.PLAIN + sum(weights.get(f, 0.0) for w in set(toxicity.WORD.findall(s)) for f in toxicity.features(w))
        left *= 1 - 1 / (1 + np.exp(-z))
    return 1 - left


def test_toxicity_score_and_fit_are_those_of_the_noisy_or():
    rng = random.Random(22)
    words = ["ab", "cd", "grumble", "grumbling", "ef", "snarl"]
    model = toxicity.Model({"grumble": 9.0, "grumbl*": 3.0, "snarl": 15.0}, -3.0)
    for _ in range(50):
        text = "".join(rng.choice([*words, ". ", " ", "!"]) + " " for _ in range(rng.randrange(0, 25)))
        assert abs(model.score(text) - _noisy_or(model.weights, model.leak, text)) < 1e-9
    rows = [(". ".join(" ".join(rng.choice(words[:2] + words[4:5]) for _ in range(4)) for _ in range(3)) + (" snarl." if i % 4 == 0 else "."), int(i % 4 == 0 and i % 20 > 0 or i % 20 == 1), 1.0) for i in range(80)]
    fitted = toxicity.fit(rows)

    def loss(weights, leak):
        p = np.clip([_noisy_or(weights, leak, t) for t, _, _ in rows], 1e-12, 1 - 1e-12)
        y = np.array([label for _, label, _ in rows])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + toxicity.DECAY / 2 * sum(w * w for w in weights.values()) / max(1, len(weights))

    assert set(fitted.weights) == {"snarl"}
    best = loss(fitted.weights, fitted.leak)  # no step in either direction gets lower
    for d in (-0.3, 0.3):
        assert best <= loss({"snarl": fitted.weights["snarl"] + d}, fitted.leak) + 1e-4 and best <= loss(fitted.weights, fitted.leak + d) + 1e-4


def test_a_text_too_long_for_the_sample_is_passed_over(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 60_000)
    rng = random.Random(23)
    docs = [(i, " ".join(rng.choice(["ka", "lo", "mi"]) for _ in range(10)) + (" scoundrel." if i % 4 == 0 else ".")) for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)]
    long_ones = [(i, "ka " * 30_000) for i in range(1000, 1040)]
    df = spark.createDataFrame(docs + long_ones, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(i, 1) for i, _ in long_ones], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(df, lab).collect()}
    assert all(got[i] == int(i % 4 == 0) for i in range(400))
    empty = toxicity.toxicity(df.limit(0), lab)
    assert empty.count() == 0 and toxicity.without_toxic(df.limit(0), lab).count() == 0
    assert {r.score for r in toxicity.toxicity(df, lab.limit(0)).collect()} == {0.0}


def test_licenses_by_ordered_sentences(spark):
    grant, notice, warranty = (s for s, i in licenses.SENTENCES.items() if i in ("mit/grant", "mit/notice", "mit/warranty"))
    rows = [
        (1, "Code.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
        (2, f"{grant}. {notice}. Foo bar. {warranty}"),
        (3, f"{warranty}. {grant}."),
        (4, f"{grant}. a. b. c. {warranty}."),
        (5, "the license of nothing"),
        (6, None),
        (7, ""),
        (8, "word " * 20000 + ".\nThis work is licensed  under the GNU General Public License, version 3!"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: (r.n_license_sentences, r.licenses) for r in licenses.license_scan(df).collect()}
    assert got == {1: (2, "Apache-2.0 MIT"), 2: (3, "MIT"), 3: (2, ""), 4: (2, ""), 5: (0, ""), 6: (0, ""), 7: (0, ""), 8: (1, "GPL-3.0")}
    assert licenses.license_scan(df.limit(0)).count() == 0
    plan = licenses.license_scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


GPL = """This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{stop} either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
NOTICES = {
    "GPL-3.0": GPL.format(mark=":", stop=",", version=3),
    "GPL-2.0": GPL.format(mark=";", stop=";", version=2),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT": """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-3-Clause BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "AGPL-3.0": GPL.format(mark=":", stop=",", version=3).replace("GNU General", "GNU Affero General"),
    "LGPL-2.1": GPL.format(mark=";", stop=";", version="2.1").replace("program", "library").replace("GNU General", "GNU Lesser General"),
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
}
COUNTS = {"AGPL-3.0": 2, "LGPL-2.1": 2, "ISC": 2, "Zlib": 2, "GPL-3.0": 2, "GPL-2.0": 2, "MPL-2.0": 2, "MIT": 3, "Apache-2.0": 5, "BSD-3-Clause BSD-2-Clause": 4, "Unlicense": 1}


@pytest.mark.parametrize("width", [10_000, 75, 30])
def test_whole_notices_wrapped_and_not(spark, width):
    import textwrap

    rows = []
    for name, notice in NOTICES.items():
        lines = [line for p in notice.split("\n\n") for line in [*textwrap.wrap(p, width, break_long_words=False), ""]]
        rows += [(name, "\n".join(lines)), (name, "\r\n".join(lines)), (name, "\n".join("# " + x for x in lines)), (name, "Some words without a stop\n" + "\n".join(lines) + "and more")]
    _, _, grant, _, warranty = NOTICES["MIT"].split("\n\n")
    rows += [("", f"{grant}\n\n日本\n\n語\n\n字\n\n{warranty}"), ("MIT", f"{grant}\n\n日本\n語\n字\n\n{warranty}")]
    df = spark.createDataFrame(rows, "name string, text string").withColumn("doc_id", F.monotonically_increasing_id())
    got = licenses.license_scan(df).join(df, "doc_id").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.licenses == r.name, r
        assert "日" in r.text or r.n_license_sentences == COUNTS[r.name], r


def test_bounds_are_optimal():
    rng = np.random.default_rng(11)
    from itertools import combinations

    for _ in range(25):
        lengths = np.sort(rng.choice(np.arange(1, 40), rng.integers(1, 9), replace=False))
        counts = rng.integers(1, 20, len(lengths))
        for k in (1, 2, 3):
            pad = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
            best = min(pad([*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in combinations(lengths[:-1].tolist(), r))
            assert pad(packing.optimal_bounds(lengths, counts, k)) == best


def test_packing_places_every_piece(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60))) for i in range(300)] + [(400, None), (401, " \t"), (402, "w " * 210), (7, "w"), (7, "w")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("piece", F.lit("clash"))
    got = packing.pack(df, max_tokens=64, buckets=4, budget=256, slice_bytes=1000).toPandas()
    assert got[got.doc_id == 402].n_tokens.sort_values().tolist() == [18, 64, 64, 64]
    assert got.n_tokens.sum() == sum(len((t or "").split()) for _, t in rows)
    texts = got.sort_values(["doc_id", "piece"]).groupby("doc_id").text.apply("".join)
    assert all(texts[i] == (t or "") for i, t in rows if i != 7) and all(len(t.split()) == n for t, n in zip(got.text, got.n_tokens, strict=True))
    assert got[got.n_tokens == 0].bucket_tokens.isna().all() and (got.n_tokens == 0).sum() == 2
    full = got[got.n_tokens > 0]
    assert (full.n_tokens <= full.bucket_tokens).all() and (full.n_padding == full.bucket_tokens - full.n_tokens).all() and full.bucket_tokens.nunique() <= 4
    for (bound, batch), g in full.groupby(["bucket_tokens", "batch"]):
        room = int(256 // bound)
        assert sorted(g.slot) == list(range(len(g))) and len(g) <= room
        last = full[full.bucket_tokens == bound].batch.max()
        assert len(g) == room or batch == last
    assert packing.pack(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c")] * 300, "doc_id long, text string").repartition(4)
    packed = packing.pack(nulls, budget=30, slice_bytes=1000).toPandas()
    assert len(packed) == 300 and packed.batch.nunique() == 30 and packed.groupby("batch").size().eq(10).all()


def test_pieces_of_any_text_and_chunk(monkeypatch):
    rng = random.Random(24)
    import pyarrow as pa

    texts = ["".join(rng.choice(["a", "é", " ", "\n", "\x0b", "\u00a0"]) for _ in range(rng.randrange(0, 60))) for _ in range(60)] + [None, "", "   ", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    for chunk in (packing.CHUNK, 7):
        monkeypatch.setattr(packing, "CHUNK", chunk)
        got = packing._pieces(4)(batch).to_pandas()
        for i, t in enumerate(texts):
            own = got[got.doc_id == i]
            words = [w for w in (t or "").replace("\x0b", " ").replace("\n", " ").split(" ") if w]
            assert "".join(own.text) == (t or "") and own.n_tokens.sum() == len(words) and own.piece.tolist() == list(range(max(1, -(-len(words) // 4))))
            assert own.first_token.tolist() == [4 * p for p in own.piece] and (own.n_tokens <= 4).all()


def test_warc_round_trip(spark):
    rows = [(i, f"http://e.org/{i}\r\nX: y", f"<p>{i % 7} é😀</p>" * (i % 3)) for i in range(60)] + [(100, None, None), (101, "u", ""), (102, "u", "x" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("target", F.lit(9)).repartition(3)
    got = {r.page_id: r for r in warc.warc_round_trip(df).collect()}
    payload = {i: (h or "").encode() for i, _, h in rows}
    assert sorted(got) == sorted(payload)
    for i, p in payload.items():
        largest = max(j for j, q in payload.items() if q == p)
        want = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == largest else "revisit", None if i == largest else largest)
        assert tuple(got[i])[1:] == want
    index = warc.write_archives(df, Scratch(spark, "test"))
    some = warc.read_records(index.where("page_id in (100, 102)"), with_payload=True).collect()
    assert {r.page_id: len(r.payload or b"") for r in some if r.record_type == "response"}.get(102) == 200_000 and len(some) == 2
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_coalesced_ranges():
    assert warc.coalesce_ranges([(0, 10), (10, 5), (100, 1), (20_000_000, 3)], 100) == [(0, 101), (20_000_000, 3)]


def test_transcripts_in_segments_and_as_one(spark):
    rng = random.Random(13)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 12)):
            role = "system" if turn == 0 and conv % 3 == 0 else ("user" if turn % 2 else "assistant")
            rows.append((conv, turn, role, " ".join(["word"] * rng.randrange(1, 20)) + ("?" if role == "user" else ".\nmore") + ("\n" if turn % 3 else "")))
    rows += [(None, 0, "user", None), (None, None, "user", ""), (41, 0, "nobody", "hi"), (41, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1))
    one = transcripts.recover_roles(df).toPandas().sort_values(["conv_id", "turn", "rendered"]).reset_index(drop=True)
    assert len(one) == len(rows)
    for fan in (transcripts.FAN, 2):
        cut = transcripts.recover_roles(df.repartition(5), segment=2, fan=fan).toPandas().sort_values(["conv_id", "turn", "rendered"]).reset_index(drop=True)
        assert one.equals(cut)
    truth = {(c, t): r for c, t, r, _ in rows if c is not None and c < 40}
    hit = [truth[c, t] == r for c, t, r in zip(one.conv_id, one.turn, one.role, strict=True) if (c, t) in truth]
    assert np.mean(hit) > 0.93
    whole = "".join(one[one.conv_id == 5].sort_values("turn").rendered)
    assert whole.count("<|end|>") == one[one.conv_id == 5].n_turns.sum() and whole.endswith("<|end|>\n") and whole.startswith("<|")
    assert transcripts.recover_roles(df.limit(0)).count() == 0


def test_transcripts_of_hot_turns_null_ids_and_other_types(spark):
    hmm = transcripts.fit([(1, "user", True, "user: hi?"), (1, "assistant", True, "ai: yes"), (1, "assistant", False, "more"), (1, "user", True, "user: ok")])
    rows = [(None, "1", "user: a?"), (None, "2", "ai: b"), ("", "1", "user: c?"), ("", "2", "ai: d"), ("x", None, "user: e"), ("x", "no number", "ai: f"), ("x", "3", None)] + [("hot", "7", f"user: {i % 3}")for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id string, turn string, text string").repartition(4)
    got = transcripts.parse_transcripts(df, hmm, segment=8, fan=3).toPandas()
    assert len(got) == len(rows) and got.conv_id.isna().sum() == 2 and (got.conv_id == "").sum() == 2
    null, blank = got[got.conv_id.isna()].sort_values("turn").rendered.tolist(), got[got.conv_id == ""].sort_values("turn").rendered.tolist()
    assert null[0].startswith("<|user|>") and blank[0].startswith("<|user|>") and null[1].endswith("b\n<|end|>\n") and blank[1].endswith("d\n<|end|>\n")
    hot = got[got.conv_id == "hot"]
    assert hot.rendered.str.match(r"<\|(?!end)").sum() == 1 and hot.rendered.str.endswith("<|end|>\n").sum() == 1
    long_row = spark.createDataFrame([(1, 1, "user: x\n" * 30_000)], "conv_id int, turn int, text string")
    assert transcripts.parse_transcripts(long_row, hmm).first().n_turns >= 1


def test_segments_of_matrices_give_the_path_of_one_pass():
    rng = random.Random(25)
    hmm = transcripts.fit([(1, "user", True, "user: hi?"), (1, "assistant", True, "ai: yes"), (1, "assistant", False, "more"), (1, "system", True, "sys: ok")])
    lines = [rng.choice(["user: a?", "b", "ai: c", "d" * 50, "- e", ""]) for _ in range(60)]
    emit = hmm.emissions(lines)
    import pandas as pd

    part = pd.DataFrame({"conv": "c", "number": range(6), "up": 0, "start": -1, "stop": -1, "matrix": [hmm.product(emit[a : a + 10], a == 0).ravel() for a in range(0, 60, 10)]})
    ends = transcripts._between(part)
    path = np.concatenate([hmm.decode(emit[10 * i : 10 * i + 10], None if b < 0 else b, s) for i, b, s in zip(ends.number, ends.before, ends["last"], strict=True)])
    score = lambda p: hmm.start[p[0]] + hmm.move[p[:-1], p[1:]].sum() + emit[np.arange(60), p].sum()
    assert abs(score(path) - score(hmm.decode(emit, None, None))) < 1e-9  # of equally good paths, any


def test_viterbi_finds_the_best_path():
    from itertools import product

    hmm = transcripts.fit([(1, "user", True, "user: hi?"), (1, "assistant", True, "ai: yes"), (1, "assistant", False, "more"), (1, "user", True, "ok")])
    emit = hmm.emissions(["user: a?", "b", "ai: c", "d"])
    best = max(product(range(transcripts.STATES), repeat=4), key=lambda p: hmm.start[p[0]] + emit[0][p[0]] + sum(hmm.move[a, b] + e[b] for a, b, e in zip(p, p[1:], emit[1:], strict=False)))
    assert hmm.decode(emit, None, None).tolist() == list(best)
