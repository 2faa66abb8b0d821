import gzip
import json

from pyspark.sql import functions as F

from chronolith.__main__ import main
from chronolith.plans import settings
from chronolith.plans.costs import Tracker
from chronolith.plans.engine import TemporalGraph
from chronolith.plans.prompts import Prompts
from chronolith.plans.providers import Model, Providers, QueryParam, kind_of, prompted
from chronolith.sources import files, stores
from chronolith.sources.catalog import Catalog
from chronolith.streaming.ingest import insert_stream, new_documents, window_counts

DOCS = [
    ("Acme", "Acme Corp bought Bolt Inc in 2023-Q1. Carla Diaz left Acme in 2023-Q2. Bolt hired Carla in 2024-Q1."),
    ("Bolt", "Bolt Inc opened Paris office in 2024-03-05. Carla Diaz praised Paris in 2024-Q2."),
]


def test_insert_then_all_modes(spark, tmp_path):
    engine = TemporalGraph(spark, f"file://{tmp_path}/g", chunk_size=40, overlap=5)
    docs = spark.createDataFrame(DOCS, "title string, doc string")
    assert engine.insert(docs) > 0
    assert engine.insert(docs) == 0  # nothing new
    c = engine.catalog
    assert {"ACME", "BOLT", "CARLA"} <= {r.entity_name for r in c.read("nodes").collect()}
    assert {"2023", "2023-Q1", "2024-03-05"} <= {r.ts for r in c.read("th_nodes").collect()}
    root = c.read("hierarchy").where("ts = '2024'").first()
    below = engine.hierarchy_members("2024").collect()
    names = {x for r in below for x in (r.src, r.tgt)}
    assert {"BOLT", "CARLA", "PARIS"} <= names and "2024-03-05" in root.all_sub_communities
    assert (root.n_nodes, root.n_edges) == (len(names), len({(r.ts, r.src, r.tgt) for r in below}))
    assert c.read("reports").where("ts = '2024'").first().rating > 0
    local = engine.query("What did Bolt do in 2024-Q1?", QueryParam(mode="local", only_context=True, top_k=5))
    assert "Bolt" in local
    whole = engine.query("What happened?", QueryParam(mode="global", only_context=True))
    assert whole.startswith("----Analyst")
    assert "[Acme]" in engine.query("Carla Diaz left Acme", QueryParam(mode="naive", only_context=True, top_k=2))
    assert engine.query("Carla?", QueryParam(mode="naive"))
    more = spark.createDataFrame([("Dora", "Dora Lane joined Acme Corp in 2025.")], "title string, doc string")
    assert engine.insert(more) == 1
    assert {"DORA", "ACME"} <= {r.entity_name for r in c.read("nodes").collect()}
    assert {r.level for r in engine.report_communities().collect()} >= {0} and c.read("nodes").count() > 3
    assert engine.query_later("Carla?", QueryParam(mode="naive", only_context=True)).result()
    assert engine.tracker.summary()["progress"]["chunks"] >= 3 and engine.tracker.queries == 5


RECORDS = {
    "one": '("entity"<|>alpha<|>firm<|>first)##("entity"<|>beta<|>firm<|>second)##("relationship"<|>2023-Q1<|>alpha<|>beta<|>met)<|COMPLETE|>',
    "two": '("entity"<|>gamma<|>city<|>third)##("relationship"<|>2023-Q2<|>alpha<|>gamma<|>went)##("relationship"<|>2023-Q1<|>alpha<|>beta<|>met again)##("relationship"<|>2025<|>alpha<|>omega<|>saw)<|COMPLETE|>',
}


def test_a_second_insert_merges_with_what_is_stored(spark, tmp_path):
    embedded, reported = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def vectors(texts):
        embedded.add(len(texts))
        return [[1.0, float(len(t))] for t in texts]

    def report(prompt):
        reported.add(1)
        return json.dumps({"title": prompt.split("\n")[0], "summary": "s", "rating": 5})

    engine = TemporalGraph(spark, f"file://{tmp_path}/g", Providers(extract=lambda text: RECORDS[text.split()[-1]], embed_all=vectors, embed=lambda t: [1.0, 1.0], report=report))
    one = lambda name: spark.createDataFrame([("t", name)], "title string, doc string")
    engine.insert(one("one"))
    before = {r.id: r.embedding for r in engine.catalog.read("entity_vectors").collect()}
    first_reports = {r.ts: r.report_string for r in engine.catalog.read("reports").collect()}
    embedded.value, reported.value = 0, 0
    engine.insert(one("two"))
    nodes = {r.entity_name: r for r in engine.catalog.read("nodes").collect()}
    assert (nodes["ALPHA"].entity_type, nodes["ALPHA"].description) == ("FIRM", "first") and nodes["ALPHA"].source_id
    assert nodes["BETA"].entity_type == "FIRM" and nodes["GAMMA"].entity_type == "CITY" and nodes["OMEGA"].entity_type == "UNKNOWN"
    facts = {(r.src, r.tgt, r.ts): r.description for r in engine.catalog.read("edge_facts").collect()}
    assert facts == {("ALPHA", "BETA", "2023-Q1"): "met again", ("ALPHA", "GAMMA", "2023-Q2"): "went", ("ALPHA", "OMEGA", "2025"): "saw"}
    after = {r.id: r.embedding for r in engine.catalog.read("entity_vectors").collect()}
    assert before.items() <= after.items() and len(after) == 4
    assert embedded.value == 2 + 3 + 1  # new nodes, new facts, the chunk
    assert {(r.ts, r.entity) for r in engine.catalog.read("time_links").collect()} >= {("2023-Q1", "ALPHA"), ("2025", "OMEGA")}
    assert reported.value == 4 and set(first_reports) == {"2023", "2023-Q1"} and {r.ts for r in engine.catalog.read("reports").collect()} == {"2023", "2023-Q1", "2023-Q2", "2025"}
    sizes = {r.ts: (r.n_nodes, r.n_edges) for r in engine.catalog.read("hierarchy").collect()}
    assert sizes == {"2023": (3, 2), "2023-Q1": (2, 1), "2023-Q2": (2, 1), "2025": (2, 1)}
    embedded.value, reported.value = 0, 0
    RECORDS["three"] = '("relationship"<|>2025-Q1<|>alpha<|>omega<|>left)<|COMPLETE|>'
    engine.insert(one("three"))
    assert reported.value == 2 and engine.catalog.read("nodes").where("entity_name = 'ALPHA'").first().entity_type == "FIRM"


def test_supplemental_evidence_and_details(spark, tmp_path):
    engine = TemporalGraph(spark, f"file://{tmp_path}/g", chunk_size=40, overlap=5)
    engine.insert(spark.createDataFrame(DOCS, "title string, doc string"))
    for question, seeds in (("What did Carla do in 2023-Q2?", "relations"), ("Who is Paris?", "entities")):
        answer, details = engine.query_with_details(question, QueryParam(only_context=True, seeds=seeds, top_k=5))
        assert details["total_evidence"] == sum(v for k, v in details.items() if k != "total_evidence") and details["text_units"] >= 2
        assert details["entity"] > 0 and details["relation"] > 0 and answer.count("--New Chunk--") == details["text_units"] - 1
    alone, few = engine.query_with_details("Carla in 2023-Q2?", QueryParam(only_context=True, least_evidence=0, top_k=5))
    assert few["entity"] == 0 and alone

    def broken(text):
        raise RuntimeError

    engine.providers = Providers(respond=broken)
    assert engine.query_with_details("Carla?") == (engine.providers.fail_response, {"entity": 0, "relation": 0, "community": 0, "text_units": 0, "total_evidence": 0})
    assert {r.ts for r in engine._asked("What of 2024-Q1?", QueryParam()).collect()} >= {"2024-Q1"}


def test_extraction_ladder_and_gleaning():
    calls = []

    def fail(text):
        calls.append("main")
        raise TimeoutError

    p = Providers(extract=fail, extract_simple=lambda t: calls.append("simple") or "short", extract_basic=lambda t: calls.append("basic") or RECORDS["one"])
    assert p.records("x") == RECORDS["one"] and calls == ["main", "simple", "basic"]
    assert Providers(extract=fail).records("x") == ""
    turns = []
    p = Providers(extract=lambda t: RECORDS["one"], glean=lambda t, found: turns.append(1) or "##more", more=lambda t, found: '"Yes"' if len(turns) < 2 else "no", max_gleaning=5)
    assert p.records("x").endswith("##more##more") and len(turns) == 2
    assert Providers().similarity("a b c", "a b c") > 0.99 and Providers(alike=lambda a, b: 7).similarity("a", "b") == 1.0


def test_models_prompts_and_settings(spark, tmp_path):
    sent = []

    def send(kind, model, packed):
        sent.append((kind, packed))
        if len(sent) == 1:
            raise ConnectionError
        return f"{kind} {len(packed)}"

    m = Model("gemini-x", send, wait=(0.0, 0.0))
    assert m("hello") == "gemini 1" and m("hello") == "gemini 1" and (m.hits, m.misses, len(sent)) == (1, 1, 2) and m("hello", "hi", "more") == "gemini 3"
    assert kind_of("us.some-model") == "bedrock" and kind_of("llama3") == "ollama" and kind_of("anything") == "openai"
    assert Model("x", send, "bedrock", wait=(0, 0))("q") and sent[-1][1] == [{"role": "user", "content": [{"text": "q"}]}]
    (tmp_path / "prompts.json").write_text(json.dumps({"query": {"local": "Say {input_text}{tuple_delimiter}"}, "record_delimiter": "@@"}))
    prompts = Prompts(str(tmp_path / "prompts.json"))
    assert prompts.format("local", input_text="x") == "Say x<|>" and "@@" in prompts.format("extract", input_text="t") and prompts.valid("report") and not prompts.valid("nothing")
    assert prompts.format("local") == "Say {input_text}{tuple_delimiter}"
    asked = prompted(lambda *turns: turns[0], prompts)
    assert asked.respond("x") == "Say x<|>" and asked.points("r").endswith("r")
    (tmp_path / "c.json").write_text(json.dumps({"building": {"chunk_size": 40, "model": "gemini-2", "chunk_overlap": None, "odd": 1}, "querying": {"top_k": 5, "mode": "naive"}}))
    loaded = settings.load(str(tmp_path / "c.json"), "building", {"working_dir": f"file://{tmp_path}/g", "chunk_size": None})
    assert (loaded.chunking.chunk_size, loaded.chunking.chunk_overlap, loaded.models.provider, loaded.others["odd"]) == (40, 100, "gemini", 1)
    (tmp_path / "a.txt").write_text("Acme Corp met Bolt Inc in 2023.")
    assert main(["build", "--config", str(tmp_path / "c.json"), "--working-dir", f"file://{tmp_path}/g", "--corpus", str(tmp_path / "a.txt"), "--chunk-overlap", "5"], spark) == 1
    assert "Acme" in main(["ask", "Acme?", "--config", str(tmp_path / "c.json"), "--working-dir", f"file://{tmp_path}/g", "--only-context"], spark)


def test_stores_of_other_tools(spark, tmp_path):
    (tmp_path / "kv.json").write_text(json.dumps({"a": {"x": "1"}, "b": {"x": "2", "y": "z"}}))
    assert {r.id: r.value for r in stores.json_store(spark, str(tmp_path / "kv.json")).collect()} == {"a": {"x": "1"}, "b": {"x": "2", "y": "z"}}
    assert stores.json_store(spark, str(tmp_path / "none.json")).count() == 0
    stores.write_json_store(stores.json_store(spark, str(tmp_path / "kv.json")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    (tmp_path / "v.json").write_text(json.dumps({"data": [{"id": "1", "vector": [1.0, 2.0], "entity_name": "A"}]}))
    assert [(r.id, r.embedding, r.entity_name) for r in stores.vector_store(spark, str(tmp_path / "v.json")).collect()] == [("1", [1.0, 2.0], "A")]
    (tmp_path / "g.graphml").write_text("""<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="entity_type" attr.type="string"/><key id="d1" for="edge" attr.name="description" attr.type="string"/>
<graph edgedefault="undirected"><node id="A"><data key="d0">FIRM</data></node><node id="B"><data key="d0">CITY</data></node>
<edge source="A" target="B"><data key="d1">{"2023": "met"}</data></edge></graph></graphml>""")
    nodes, edges = stores.graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.id: r.attributes for r in nodes.collect()} == {"A": {"entity_type": "FIRM"}, "B": {"entity_type": "CITY"}}
    edge = edges.first()
    assert (edge.src, edge.tgt, edge.attributes) == ("A", "B", {"description": '{"2023": "met"}'})
    assert stores.restored(spark.createDataFrame([('{"2023": "met"}',)], "d string"), ["d"]).first().d == {"2023": "met"}
    try:
        files.documents(spark, str(tmp_path / "missing"))
    except FileNotFoundError:
        pass
    else:
        raise AssertionError


def test_costs_are_saved(spark, tmp_path):
    t = Tracker()
    t.add(spark.createDataFrame([(1000.0, 500.0, 0.0, True), (0.0, 0.0, 2000.0, False)], "prompt double, completion double, embedding double, hit boolean"))
    t.done(chunks=3)
    t.asked(True)
    t.asked(False)
    t.note(corpus="x")
    s = t.summary()
    assert (s["calls"], s["cost_usd"], s["cache_hit_pct"], s["answered_pct"], s["prompt_to_completion"]) == (2, round(0.0015 + 0.001 + 0.00004, 4), 50.0, 50.0, 2.0)
    t.save(spark, f"file://{tmp_path}/report")
    saved = json.loads(spark.read.text(f"file://{tmp_path}/report").first()[0])
    assert saved["corpus"] == "x" and saved["summary"]["progress"] == {"chunks": 3} and "cost_usd" in str(t)


def test_unknown_mode_fails(spark, tmp_path):
    engine = TemporalGraph(spark, f"file://{tmp_path}/g")
    try:
        engine.query("x", QueryParam(mode="nothing"))
    except ValueError as e:
        assert "mode" in str(e)
    else:
        raise AssertionError


def test_catalog_versions(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    assert c.read("t", "id int, v string").count() == 0
    c.write("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    c.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"])
    assert sorted((r.id, r.v) for r in c.read("t").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    fresh = c.new_keys("t", spark.createDataFrame([(3,), (4,)], "id int"), "id")
    assert [r.id for r in fresh.collect()] == [4]
    for _ in range(4):
        c.write("t", c.read("t"))
    kept = [x.name for x in (tmp_path / "c" / "t").iterdir() if not x.name.startswith((".", "_"))]
    assert len(kept) == 3 and c.read("t").count() == 3
    c.truncate("t")
    assert c.read("t").count() == 0
    c.drop_all()
    assert c.version("t") is None


def test_sources(spark, tmp_path):
    rows = [{"cleaned_content": None, "raw_content": "raw", "company_name": "Acme", "year": 2023, "quarter": "q2"}, {"cleaned_content": "clean", "raw_content": "raw", "company_name": "Bolt"}, {"company_name": "None"}]
    with gzip.open(tmp_path / "corpus.jsonl.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, rows)))
    got = files.documents(spark, str(tmp_path / "corpus.jsonl.gz")).collect()
    assert [(r.title, r.doc) for r in got] == [("Acme 2023 Q2", "raw"), ("Bolt", "clean")]
    assert files.corpus(spark, str(tmp_path / "corpus.jsonl.gz"), 1).count() == 1
    folder = tmp_path / "texts"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text(" one ")
    (folder / "sub" / "b.md").write_text("two")
    (folder / "sub" / "noending").write_text("three")
    (folder / "empty.txt").write_text("  ")
    (folder / "skip.pdf").write_text("four")
    (folder / "bad.txt").write_bytes(b"\xff\xfe\x00")
    got = files.documents(spark, str(folder)).collect()
    assert [(r.title, r.doc) for r in got] == [("a", "one"), ("sub/b", "two"), ("sub/noending", "three")]
    assert [(r.title, r.doc) for r in files.documents(spark, str(folder / "a.txt")).collect()] == [("a", "one")]
    (tmp_path / "q.jsonl").write_text('{"question": "Q?", "role": "r", "type": "t"}\n')
    assert files.questions(spark, str(tmp_path / "q.jsonl")).first().type == "t"


def test_streams(spark, tmp_path, sf):
    src = tmp_path / "in"
    spark.createDataFrame([(t, d, "2024-01-01 00:00:00") for t, d in DOCS + DOCS], "title string, doc string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(src))
    stream = spark.readStream.schema("title string, doc string, ts timestamp").parquet(str(src))
    q = new_documents(stream).writeStream.format("memory").queryName("fresh").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("fresh").count() == 2
    engine = TemporalGraph(spark, f"file://{tmp_path}/g", chunk_size=40, overlap=5)
    q = insert_stream(stream, engine, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert engine.catalog.read("full_docs").count() == 2
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parquet*")
    q = window_counts(events, "event_type").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").count()
    assert spark.table("counts").agg(F.sum("n"), F.count("n")).first() == batch.agg(F.sum("count"), F.count("count")).first()
