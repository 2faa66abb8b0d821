import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import minhash_dedup as mh
from chronolith.llm import rabitq
from chronolith.llm import suffix_dedup as sa
from chronolith.llm.common import Scratch, connected_components, union_find

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def _documents():
    rng = random.Random(5)
    base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(80)]
    docs = []
    for i in range(60):  # a large group of near copies, some of them chained
        t = list(base)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(9)}"
        docs.append((100 + i, " ".join(t)))
    docs += [(200 + i, " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(60))) for i in range(20)]
    docs += [(300, None), (301, ""), (302, " \t\n"), (303, "one two"), (304, "ONE  two"), (305, "one two three"), (306, "é É"), (307, "é é"), (308, docs[0][1].upper()), (309, docs[0][1])]
    docs += [(310, "long " * 3000), (311, "long " * 2999), (303, "one two")]
    return docs


def _brute(docs, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for a, i in enumerate(ids) for b, j in enumerate(ids[:a]) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    p = union_find(len(ids), np.array([x for x, _ in links], int), np.array([y for _, y in links], int))
    return {i: (len(sets[i]), ids[p[a]]) for a, i in enumerate(ids)}


@pytest.mark.parametrize(("percent", "group"), [(85, mh.GROUP), (80, 8)])
def test_minhash_against_all_pairs(spark, percent, group):
    docs = _documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_shingles", F.lit("clash")).repartition(3)
    got = mh.minhash_dedup(df, percent, group=group).collect()
    want = _brute(docs, percent)
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id), r


def test_minhash_of_nothing(spark):
    assert mh.minhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_band_buckets_are_sifted_to_forests_of_possible_pairs():
    rng = np.random.default_rng(32)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 300 - 15 * i], rng.integers(0, 2**63, 15 * i).astype(np.uint64)])) for i in range(12)]
    sketches, sizes = mh.odd_sketches(mh.signatures(sets)), np.array([len(s) for s in sets])
    z = np.bitwise_count(sketches[:, None] ^ sketches[None]).sum(-1)
    ok, bits = mh.possible_pairs(sketches, sizes, 85, slice(0, 12))
    assert (bits == z).all()
    for i in range(12):
        for j in range(12):
            assert ok[i, j] == (i < j and z[i, j] <= mh.largest_count(0.85) and 100 * min(sizes[i], sizes[j]) >= 85 * max(sizes[i], sizes[j]))
            same = len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
            assert same < 0.85 or i >= j or ok[i, j]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1] * 12 + [2]), pa.array([*range(12), 5]), pa.array([*sizes.tolist(), 3]), pa.array([s.tobytes() for s in sketches] + [sketches[0].tobytes()])], names=["band", "rep", "n", "s"])
    links = [(a, b) for out in mh._bucket_forests(85)([batch]) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    want = union_find(12, *np.nonzero(ok))
    got = union_find(12, np.array([a for a, _ in links], int), np.array([b for _, b in links], int))
    assert got.tolist() == want.tolist() and len(links) < 12


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    for share in (0.7, 0.85, 0.95):
        errors = []
        for _ in range(40):
            common = rng.integers(0, 2**63, int(1000 * share)).astype(np.uint64)
            sets = [np.sort(np.concatenate([common, rng.integers(0, 2**63, int(500 * (1 - share))).astype(np.uint64)])) for _ in range(2)]
            a, b = mh.odd_sketches(mh.signatures(sets))
            errors.append(mh.sketch_similarity(int(np.bitwise_count(a ^ b).sum())) - share)
        assert abs(np.mean(errors)) < 0.03


def _repeat_brute(texts, length):
    from collections import Counter

    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        lo, _ = sa._spans(gone)
        out.append((len(t), int(gone.sum()), len(lo), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [sa.SHARD_BYTES, 300])
def test_suffix_arrays_against_all_windows(spark, shard):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(90))
    texts = [None, "", "short", "ab" * 200, "x" * 150, "x" * 149, passage, passage, passage[3:70]]
    texts += ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(30, 90))) + passage[rng.randrange(0, 20) : rng.randrange(50, 90)] + "".join(rng.choice("abcdefghijkl") for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("key", F.lit(1)).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sa.suffix_array_dedup(df, 40, shard_bytes=shard).collect()}
    assert [got[i] for i in range(len(texts))] == _repeat_brute([(t or "").encode() for t in texts], 40)


def test_chunks_of_a_long_text_name_the_same_windows(monkeypatch):
    rng = np.random.default_rng(31)
    for n in (10, 39, 40, 41, 200, 999):
        data = rng.integers(97, 100, n).astype(np.uint8)
        windows = lambda found: {p: int(name) for name, lo, hi, _ in zip(*found, strict=True) for p in range(lo, hi - 39)}
        text = np.where(rng.random(n) < 0.2, 32, data).astype(np.uint8)
        whole, words = windows(sa.runs(data, 40)), [x.tolist() for x in sa.word_windows(text, 3, 30)]
        monkeypatch.setattr(sa, "CHUNK", 50)
        assert windows(sa.runs(data, 40)) == whole and len(whole) == max(0, n - 39)
        assert [x.tolist() for x in sa.word_windows(text, 3, 30)] == words
        monkeypatch.undo()


def test_word_windows_of_many_rows_and_of_few(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(12))
    common, rare = (" ".join(rng.choice("klmnop") for _ in range(51)) for _ in range(2))
    inner = [common] * (common_rows := 600) + [rare] * 2 + [" ".join(rng.choice("qrst") for _ in range(51)), ""]
    assert common_rows > sa.HOT_ROWS
    texts = [f"{word()} {word()} {x} {word()}" for x in inner]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: r for r in sa.suffix_array_dedup(df, 256, words=51).collect()}
    for i, (text, x) in enumerate(zip(texts, inner, strict=True)):
        gone = x if inner.count(x) > 1 else ""
        assert (got[i].n_removed, got[i].n_spans) == (len(gone), int(bool(gone)))
        assert got[i].kept == (text.replace(gone, "") if gone else text)


def test_kept_text_has_whole_characters_only(spark):
    shared = "é" * 30
    rows = [(1, "a" + shared + "ç"), (2, "b" + shared + "Ã"), (3, "xyz"), (4, None)]
    got = {r.doc_id: r for r in sa.suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 41).collect()}
    assert got[1].kept == "a" and got[1].n_bytes - got[1].n_removed == 2  # the last letters share their first byte
    assert (got[2].kept, got[3].kept, got[4].kept) == ("b", "xyz", "")
    assert sa.suffix_array_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_hot_text_is_dealt_to_several_tasks(spark, monkeypatch):
    from chronolith.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = spark.range(100).selectExpr("id", "case when id < 70 then 'hot' when id < 90 then concat('k', id % 5) end as k").repartition(3)
    few = spark.createDataFrame([("hot", 1), ("k1", 2), ("z", 3)], "k string, v int")
    got = {r.id: r.v for r in common.join_spread(rows, few, "k", "id").collect()}
    assert got == {i: 1 if i < 70 else 2 if i < 90 and i % 5 == 1 else None for i in range(100)}
    text = "some words that stand in every copy of this text " * 10
    docs = spark.createDataFrame([(i, text if i % 2 else f"{i} {text}") for i in range(40)] + [(None, text)] * 20, "doc_id long, text string").repartition(4)
    got = sa.suffix_array_dedup(docs, 40).collect()
    assert len(got) == 60 and all(r.n_removed >= len(text) - 1 for r in got)
    links = mh.minhash_dedup(docs).collect()
    assert len(links) == 60 and {r.component_id for r in links if r.doc_id is not None} == {0} and all(r.component_id is None and r.kept for r in links if r.doc_id is None)


def test_suffix_array_order_and_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(60):
        pieces = [rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 80)).astype(np.uint8) for _ in range(rng.integers(1, 5))]
        data, ends, starts = sa.join_pieces(pieces)
        text = data.astype(np.uint16) + 1
        text[ends[starts]] = 0
        order, rank = sa.suffix_array(text, ends)
        suffix = lambda i: (bytes(data[i : ends[i]]), int(ends[i]))  # noqa: B023, E731
        assert [suffix(i)[0] for i in order] == sorted(suffix(i)[0] for i in range(len(data)))
        assert (order[rank] == np.arange(len(data))).all()
        lcp = sa.common_prefixes(data, ends, order, rank, 1000)
        for r in range(1, len(order)):
            a, b = suffix(order[r - 1])[0], suffix(order[r])[0]
            k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[r] == k


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 64))
    x[100:180] = x[0] + 0.25 * rng.standard_normal((80, 64))  # around the threshold
    x[200:240] = x[1]
    x[240:250] = 3 * x[2]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] * 64), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, rows[0][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    for cell in (rabitq.CELL, 32):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rabitq.embedding_dedup(df, cell=cell).collect()}
        y = np.array([r[1] for r in rows[:300]])
        y = y / np.linalg.norm(y, axis=1, keepdims=True)
        near = y @ y.T >= 0.9
        np.fill_diagonal(near, False)
        parent = union_find(300, *np.nonzero(near))
        for i in range(300):
            assert got[i] == (near[i].sum(), parent[i], parent[i] == i), i
        assert all(got[i] == (0, i, True) for i in range(900, 905)) and got[905] == (1, 905, True) and got[906] == (1, 905, False) and got[None] == (0, None, True)


def test_embeddings_of_nothing(spark):
    assert rabitq.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rabitq.embedding_dedup(odd).collect()) == [(i, 0, i, True) for i in (1, 2, 3)]


def test_estimates_are_unbiased_within_their_bounds():
    rng = np.random.default_rng(6)
    x = rabitq._unit(rng.standard_normal((300, 64)))
    mean, deviation = rabitq.Codes(x).estimate(slice(0, 300), slice(0, 300))
    error = (mean - x @ x.T)[~np.eye(300, dtype=bool)]
    assert abs(error.mean()) < 0.002 and np.abs(error).max() < rabitq.SIGMAS * deviation.max()


def test_pivot_recall_at_the_threshold():
    rng = np.random.default_rng(7)
    p, x, u = (rabitq._unit(rng.standard_normal((n, 64))) for n in (1000, 1000, 1000))
    u = rabitq._unit(u - (u * x).sum(1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * u
    best = lambda v: np.argpartition(-v @ p.T, rabitq.PROBES - 1, axis=1)[:, : rabitq.PROBES]
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(best(x), best(y), strict=True)]) >= 0.99


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4, "a")
    got = {r.node: r.label for r in connected_components(df, Scratch(spark, "test"), "c").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 120), 100)}


def test_batches_sent_back_are_bounded():
    import pyarrow as pa

    from chronolith.llm import common

    class Frame:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    rows = 2 * common.OUT_ROWS + 5
    run = common.map_arrow(Frame(), lambda b: pa.RecordBatch.from_arrays([pa.array(range(rows))], names=["a"]), "a long")
    got = list(run(iter([pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])])))
    assert [b.num_rows for b in got] == [common.OUT_ROWS, common.OUT_ROWS, 5] and pa.concat_arrays([b.column(0) for b in got]).to_pylist() == list(range(rows))


def test_only_hot_keys_are_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"k{i % 50}") for i in range(100)], "id long, k string")
    few = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, v int")
    saved, save = [], Scratch.save

    def kept(self, df, name):
        saved.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", kept)
    text = "some words that stand in every copy of this text " * 5
    docs = spark.createDataFrame([(i, f"{text} {i % 3}") for i in range(9)] + [(20, "no more than this")], "doc_id long, text string")
    out = mh.minhash_dedup(docs)
    assert {r.component_id for r in out.collect()} == {0, 20}
    plans = [*saved, ("out", out._jdf.queryExecution().executedPlan().toString()), ("spread", common_join(rows, few))]
    for name, plan in plans:
        hot = plan.count("(count#") or plan.count("count(1)")
        assert plan.count("BroadcastHashJoin") <= (2 if hot else 0), (name, plan)


def common_join(rows, few):
    from chronolith.llm.common import join_spread

    return join_spread(rows, few, "k", "id")._jdf.queryExecution().executedPlan().toString()
