import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronolith.llm import queries
from chronolith.llm.toxicity import train
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_over_whole_tables(spark, duck, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    if name in queries.ORACLE_SQL:
        assert_same(got, duck.execute(queries.ORACLE_SQL[name]).df())
    else:
        assert len(got) > 0


def test_stages_do_what_they_say(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "passages", "packing"]
    model = train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if model.score(r.text) < 0.7}
    one = stages["near_duplicates"](spark, docs, sf)
    assert one.columns == docs.columns

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    kept = sorted(r.doc_id for r in one.collect())
    assert not any(near(sets[a], sets[b]) for n, a in enumerate(kept) for b in kept[:n])
    assert all(any(near(sets[i], sets[j]) for j in sets if j != i) for i in sets if i not in set(kept))
    cut = stages["passages"](spark, docs, sf)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.where(F.length("text") != F.col("n_chars")).count() == 0


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5])
def test_passages_of_just_over_fifty_words(spark, sf, length):
    rng = random.Random(length)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(n))
    passage, fifty = (" ".join(word(length) for _ in range(n)) for n in (51, 50))
    own = [" ".join(word(7) for _ in range(30)) for _ in range(6)]
    texts = [f"{own[0]} {passage} {own[1]}", f"{own[2]}\n{passage}", f"{own[3]} {fifty} {own[4]}", f"{fifty} {own[5]}", None, "", passage[:60]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["passages"](spark, docs, sf).collect()}
    assert all(passage not in (t or "") for t in got.values()) and own[0] in got[0] and own[1] in got[0] and own[2] in got[1]
    assert len(fifty.encode()) >= 250 or (got[2], got[3]) == (texts[2], texts[3])
    assert got[6] == texts[6] and len(got) == len(texts)


def test_stages_over_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, label string"
    copies = "the same words stand here in this one text again and again " * 12
    rows = [(1, None, None, None, None, "k", "l"), (2, "", "en", "s", 0, None, None), (3, copies, "en", "s", len(copies), "k", "l"), (4, copies, None, "s", None, "k", "l"), (4, copies, None, "s", None, "k", "l"), (None, "no id at all", "en", "s", 12, "k", "l"), (5, "a few words", "en", "s", 11, "k", None)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0, name
        got = stage(spark, docs, sf).collect()
        if name == "toxicity":
            assert [tuple(r) for r in sorted(got, key=str)] == [tuple(r) for r in sorted(docs.collect(), key=str)]
        elif name == "near_duplicates":
            assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 3, 5] and all(len(r) == 7 for r in got)
        elif name == "passages":
            assert len(got) == 7 and {r.doc_id: r.text for r in got if r.doc_id in (2, 5)} == {2: "", 5: "a few words"}
            assert all(r.text == "" for r in got if r.doc_id in (3, 4)) and {(r.key, r.label) for r in got} == {("k", "l"), (None, None), ("k", None)}
        else:
            assert len(got) == 7 and sorted(r.text for r in got) == sorted(r[1] or "" for r in rows)


def test_whole_run(spark, sf):
    packed = corpus_pipeline.run(spark, sf)
    assert packed.count() > 0 and "batch" in packed.columns
