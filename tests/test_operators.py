from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import chunking, extraction, graph, reports, vector, window


def test_separator_chunks_keep_merge_and_overlap():
    toks = "a b . c d e . f".split()
    assert chunking.split_at(toks, [["."]], "end") == [["a", "b", "."], ["c", "d", "e", "."], ["f"]]
    assert chunking.split_at(toks, [["."]], "start") == [["a", "b"], [".", "c", "d", "e"], [".", "f"]]
    assert chunking.split_at(toks, [["."]], False) == [["a", "b"], ["c", "d", "e"], ["f"]]
    pieces = chunking.split_at(toks, [["."]], "end")
    assert chunking.merge_pieces(pieces, 5, 0) == [["a", "b", "."], ["c", "d", "e", ".", "f"]]
    assert chunking.merge_pieces(pieces, 5, 2) == [["a", "b", "."], ["b", ".", "c", "d", "e"]]
    assert chunking.merge_pieces([list("abcdefg")], 3, 1) == [list("abc"), list("cde"), list("efg")]
    assert chunking.merge_pieces([], 3, 1) == []


def test_token_windows_with_titles(spark):
    d = spark.createDataFrame([(1, "a b c d e", "T"), (2, "", "T"), (3, None, "T")], "doc_id int, text string, title string")
    rows = chunking.token_windows(d, 3, 1, title=F.col("title")).orderBy("full_doc_id", "chunk_order_index").collect()
    assert [(r.full_doc_id, r.tokens, r.content) for r in rows] == [(1, 3, "T a b"), (1, 3, "T b c"), (1, 3, "T c d"), (1, 3, "T d e"), (1, 2, "T e")]
    with pytest.raises(Exception, match="title leaves no room"):
        chunking.token_windows(d, 1, 0, title=F.col("title")).collect()


def test_next_fit_gives_an_oversized_item_its_own_group(spark):
    one = spark.range(1).select(window.next_fit(F.array(*[F.lit(x).cast("bigint") for x in (3, 4, 5, 1, 9)]), 8).alias("g")).first()
    assert one.g == [0, 0, 1, 1, 2]


def test_round_robin_skips_what_was_given(spark):
    rows = [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "x"), ("b", 1, "w"), ("c", 0, "w")]
    out = window.round_robin(spark.createDataFrame(rows, "l string, p int, k string"), "l", "p", "k", 3).orderBy("rank").collect()
    assert [(r.l, r.k) for r in out] == [("a", "x"), ("b", "w"), ("a", "y"), ("a", "z")][: len(out)] and len(out) == 3


def _pagerank(edges, seeds, alpha=0.85, steps=200):
    nodes = sorted({x for e in edges for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b in {tuple(sorted(e)) for e in edges}:
        m[at[a], at[b]] = m[at[b], at[a]] = 1
    total = m.sum(1, keepdims=True)
    m = np.divide(m, total, out=np.zeros_like(m), where=total > 0)
    p = np.array([1.0 if n in seeds else 0.0 for n in nodes])
    p = p / p.sum() if p.sum() else np.full(len(nodes), 1 / len(nodes))
    x = np.full(len(nodes), 1 / len(nodes))
    for _ in range(steps):
        x = alpha * (x @ m + x[total[:, 0] == 0].sum() * p) + (1 - alpha) * p
    return dict(zip(nodes, x, strict=True))


@pytest.mark.parametrize(("seeds", "arcs"), [(["a", "missing"], 0), (["a", "missing"], 100), (["missing"], 100)])
def test_pagerank_against_power_iteration(spark, seeds, arcs):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "f"), ("g", "g")]
    df = spark.createDataFrame(edges, "src string, tgt string")
    s = None if seeds is None else spark.createDataFrame([(x,) for x in seeds], "node string")
    got = {r.node: r.score for r in graph.personalized_pagerank(df, s, tol=1e-5, local_arcs=arcs).collect()}
    want = _pagerank(edges, seeds or [])
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-4


def test_components_and_communities(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 20)] + [("x", "y"), ("y", "z"), ("q", "q")]
    df = spark.createDataFrame(chain, "src string, tgt string")
    parts = {r.node: r.component for r in graph.components(df).collect()}
    assert {parts[f"n{i:03d}"] for i in range(21)} == {"n000"} and parts["z"] == "x" and parts["q"] == "q"
    largest = graph.largest_component(df).collect()
    assert len(largest) == 20
    clusters = graph.communities(df, max_size=5).toPandas()
    assert clusters[clusters.level == 1].groupby("cluster").size().max() <= 5


def _communities(edges, max_size=10, rounds=5):
    links = {}
    for a, b in edges:
        if a != b:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)

    def propagate(links):
        labels = {n: n for n in links}
        for _ in range(rounds):
            votes = {n: Counter([labels[m] for m in others] + [labels[n]]) for n, others in links.items()}
            labels = {n: min(v, key=lambda x: (-v[x], x)) for n, v in votes.items()}  # noqa: B023
        return labels

    top = propagate(links)
    size = Counter(top.values())
    second = propagate({n: {m for m in others if top[m] == top[n]} for n, others in links.items() if size[top[n]] > max_size})
    groups = {}
    for n in sorted(second):
        groups.setdefault((top[n], second[n]), []).append(n)
    cut = {n: "/".join([*key, *([str(i // max_size)] if len(g) > max_size else [])]) for key, g in groups.items() for i, n in enumerate(g)}
    return {(n, 0, c) for n, c in top.items()} | {(n, 1, c) for n, c in cut.items()}


def test_communities_against_brute_force(spark, sf):
    from chronolith.plans.queries import QUERIES

    rng = np.random.default_rng(16)
    group = lambda i, n: [(f"g{i}-{a:02d}", f"g{i}-{b:02d}") for a in range(n) for b in range(a) if rng.random() < 0.7]
    edges = [e for i, n in enumerate((8, 9, 7, 25, 3)) for e in group(i, n)] + [(f"g{i}-00", f"g{i + 1}-01") for i in range(4)] + [("z", "z"), ("hub", "z")]
    edges += [("hub", f"leaf{i}") for i in range(30)] + [("leaf3", "leaf4"), ("leaf4", "leaf5"), ("leaf3", "leaf5")]
    df = spark.createDataFrame(edges, "src string, tgt string")
    for size in (10, 5):
        assert {tuple(r) for r in graph.communities(df, size).collect()} == _communities(edges, size)
    events = {(f"USER {r.user_id}", r.event_type.upper()) for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
    assert {tuple(r) for r in QUERIES["p4_communities"](spark, sf).collect()} == _communities(events)


def test_hierarchy_of_mixed_levels(spark):
    t = spark.createDataFrame([("2024-01-05", "c1"), ("2024-Q3", "c2"), ("2024", "c3"), ("UNKNOWN_TIME", "c4"), ("2024-W02", "c5")], "ts string, source_id string")
    nodes, edges = graph.hierarchy(t)
    got = {r.ts: (r.level, r.instantiation) for r in nodes.collect()}
    assert got["2024"] == (0, True) and got["2024-Q1"] == (1, False) and got["2024-01-05"] == (3, True) and "UNKNOWN_TIME" not in got
    pairs = {(r.parent, r.child) for r in edges.collect()}
    assert {("2024", "2024-Q1"), ("2024-Q1", "2024-01"), ("2024-01", "2024-01-05"), ("2024", "2024-Q3"), ("2024-Q1", "2024-W02")} == pairs
    reach = {(r.ancestor, r.descendant) for r in graph.closure(edges).collect()}
    assert ("2024", "2024-01-05") in reach and len(reach) == 9


def test_records_by_all_routes(spark):
    response = '("entity"<|>acme<|>company<|>a firm)##("entity"<|>Q1 2024<|>quarter)##("relationship"<|>Q1 2024<|>acme<|>bob<|>met)##("relationship"<|>acme<|>eve<|>sold in 2023-Q2)##("event"<|>x<|>y)##bad##("entity"<|>a)<|COMPLETE|>'
    parsed = extraction.records(spark.createDataFrame([("k", response), ("e", ""), ("n", None)], "chunk_id string, r string"), "chunk_id", "r")
    ents = {(r.entity_name, r.entity_type, r.is_temporal) for r in extraction.entities(parsed, "chunk_id").collect()}
    assert ents == {("ACME", "COMPANY", False), ("2024-Q1", "QUARTER", True)}
    rels = {(r.src, r.tgt, r.ts, r.level, r.route) for r in extraction.relations(parsed, "chunk_id").collect()}
    assert rels == {("ACME", "BOB", "2024-Q1", 1, "temporal"), ("ACME", "EVE", "2023-Q2", 1, "mined"), ("EVENT", "X", "UNKNOWN_TIME", 1, "disguised")}


def test_vector_query_fills_up_below_the_threshold(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.1]), (4, [0.0, 0.0])], "id int, embedding array<double>")
    got = [(r.id, r.below_threshold) for r in vector.query(v, [1.0, 0.0], 5).collect()]
    assert got == [(1, False), (2, True), (3, True)]
    assert [r.id for r in vector.query(v, [1.0, 1.0], 5).collect()] == [1, 2]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_stored_index_has_its_recall_at_the_defaults(spark, tmp_path, folder):
    from chronolith.sources.catalog import Catalog

    e = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    index = vector.CellIndex(Catalog(spark, f"file://{tmp_path}/i"))
    assert index.upsert(e) == e.count()
    x = {r.id: np.array(r.embedding) for r in e.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    asked = [i for i in ids.tolist() if i % 100 == 0][:8]
    hit = sum(len({r.id for r in index.query(x[i].tolist(), 10).collect()} & set(ids[np.argsort(-(m @ (x[i] / np.linalg.norm(x[i]))))[:10]].tolist())) for i in asked)
    assert hit >= 0.9 * 10 * len(asked)


def test_stored_index_by_times_and_capacity(spark, tmp_path):
    from chronolith.sources.catalog import Catalog

    rows = [("a", "ALPHA", "met in 2023", "PERSON", [1.0, 0.0]), ("b", "BETA", "none", "PERSON", [0.9, 0.1]), ("c", "2024", None, "YEAR", [0.5, 0.5]), ("d", "DELTA", "none", "PERSON", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, entity_name string, description string, entity_type string, embedding array<double>")
    index = vector.CellIndex(Catalog(spark, f"file://{tmp_path}/i"), cells=2, probes=2, capacity=4)
    assert index.upsert(df.limit(0)) == 0 and index.upsert(df) == 4 and index.upsert(df.where("id = 'a'")) == 4
    assert [r.id for r in index.temporal_query([1.0, 0.0], ["DELTA"], 5).collect()] == ["a", "c", "d"]
    with pytest.raises(ValueError):
        index.upsert(df.withColumn("id", F.concat("id", F.lit("2"))))


def test_coded_windows_with_a_tokenizer_of_ones_own(spark):
    docs = spark.createDataFrame([(1, "T", "abcdefghij"), (2, "T", ""), (3, "T", None)], "doc_id int, title string, doc string")
    encode, decode = lambda x: [ord(c) for c in x], lambda ids: "".join(map(chr, ids))
    got = chunking.coded_windows(docs, encode, decode, 5, 2, "doc_id", "doc", "title").orderBy("chunk_order_index").collect()
    assert [(r.full_doc_id, r.content, r.tokens) for r in got] == [(1, "Tabcd", 5), (1, "Tcdef", 5), (1, "Tefgh", 5), (1, "Tghij", 5), (1, "Tij", 3)]


def test_enumeration_over_partitions(spark):
    rows = spark.range(200).select((F.col("id") * 7919 % 200).alias("x")).repartition(5)
    got = {r.x: r.id for r in window.enumerate_rows(rows, [F.desc("x")]).collect()}
    assert got == {i: 199 - i for i in range(200)} and window.enumerate_rows(rows.limit(0), [F.col("x")]).count() == 0


def test_merging_with_stored_nodes(spark):
    schema = "entity_name string, entity_type string, description string, source_id string"
    stored = spark.createDataFrame([("A", "FIRM", "old<SEP>older", "c1"), ("B", "UNKNOWN", "", ""), ("Z", "FIRM", "kept", "c0")], schema)
    rows = spark.createDataFrame([("A", "PERSON", "new", "c2", 5), ("B", "CITY", "big", "c2", 6), ("C", "CITY", "x", "c3", 7)], schema + ", seq bigint")
    got = {r.entity_name: (r.entity_type, r.description, r.source_id) for r in graph.merge_nodes(rows, stored).collect()}
    assert got == {"A": ("PERSON", "new<SEP>old<SEP>older", "c1<SEP>c2"), "B": ("CITY", "big", "c2"), "C": ("CITY", "x", "c3")}
    twice = rows.union(spark.createDataFrame([("A", "FIRM", "new", "c4", 9)], schema + ", seq bigint"))
    assert {r.entity_name: r.entity_type for r in graph.merge_nodes(twice, stored).collect()}["A"] == "FIRM"


def test_round_robin_trims_lists_exactly(spark):
    rng = np.random.default_rng(41)
    for _ in range(4):
        lists = {name: [int(x) for x in rng.permutation(40)[: rng.integers(1, 40)]] for name in "abc"}
        seen, out, at = set(), [], dict.fromkeys(lists, 0)
        while len(out) < 9 and any(at[n] < len(x) for n, x in lists.items()):
            for n, x in lists.items():
                while at[n] < len(x) and x[at[n]] in seen:
                    at[n] += 1
                if at[n] < len(x):
                    seen.add(x[at[n]])
                    out.append((n, x[at[n]]))
        df = spark.createDataFrame([(n, p, x) for n, xs in lists.items() for p, x in enumerate(xs)], "l string, p int, k int")
        assert [(r.l, r.k) for r in window.round_robin(df, "l", "p", "k", 9).orderBy("rank").collect()] == out


def test_approximate_search_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    q = e.where("id % 50 = 0")
    got = vector.approximate_query(e, q, 5, tables=24, bits=5).toPandas()
    x = {r.id: np.array(r.embedding) for r in e.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    hit = total = 0
    for i in [r.id for r in q.collect()]:
        best = set(ids[np.argsort(-(m @ (x[i] / np.linalg.norm(x[i]))))[:5]].tolist())
        hit += len(best & set(got[got.query_id == i].id))
        total += 5
    assert hit / total >= 0.9


def test_registered_neighbours_are_all_found(spark):
    from chronolith.plans.queries import QUERIES

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        got = QUERIES["v3_approximate_neighbours"](spark, sf).toPandas()
        x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
        ids = np.array(sorted(x))
        m = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
        asked = [i for i in ids.tolist() if i % 100 == 0]
        hit = sum(len(set(ids[np.argsort(-(m @ (x[i] / np.linalg.norm(x[i]))))[:10]].tolist()) & set(got[got.query_id == i].id)) for i in asked)
        assert hit == 10 * len(asked) == len(got)


def test_exact_neighbours_in_blocks(spark):
    rng = np.random.default_rng(15)
    x = rng.standard_normal((60, 4))
    x[10:30] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [0.0] * 4), (92, [1.0]), (93, [float("nan")] * 4), (94, [None] * 4)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    whole = vector.exact_neighbours(df, df, 7, 4).orderBy("query_id", "rank").collect()
    assert vector.exact_neighbours(df, df, 7, 4, block=9).orderBy("query_id", "rank").collect() == whole
    assert len(whole) == 7 * 60 and [r.id for r in whole if r.query_id == 20] == [3, 10, 11, 12, 13, 14, 15]
    assert vector.exact_neighbours(df, df.limit(0), 7, 4).count() == 0


@pytest.mark.parametrize("budget", [10, 37, 400])
def test_report_groups_over_partitions(spark, budget):
    rng = np.random.default_rng(17)
    tokens = [int(x) for x in rng.choice([0, 0, 1, 3, 9, 11, 30, 50], 300)]
    df = spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(tokens)], "ts string, tokens bigint").repartition(7)
    want, used, group = {}, 0, -1
    for i, t in enumerate(tokens):
        used, group = (t, group + 1) if group < 0 or used + t > budget else (used + t, group)
        want[f"{i:03d}"] = t, group
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for merged in ("false", "true"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
            assert {r.ts: (r.tokens, r.group) for r in reports.report_groups(df, [F.col("ts")], budget).collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert reports.report_groups(df.limit(0), [F.col("ts")], budget).count() == 0


def test_all_reports_are_grouped(spark, tmp_path):
    from chronolith.plans.queries import QUERIES

    n = 101_000
    spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["e13_report_groups"](spark, str(tmp_path)).count() == sum(i % 11 >= 2 for i in range(n))


def test_report_repair_and_points(spark):
    one = spark.createDataFrame([('{"title": "T", "rating": 99}',), ("junk",)], "r string").select(reports.repair_report(F.from_json("r", reports.REPORT)).alias("x")).collect()
    assert (one[0].x.title, one[0].x.rating, one[0].x.findings) == ("T", 10.0, []) and one[1].x.title == "Untitled"
