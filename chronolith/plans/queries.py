"""The engine's operators as queries over the driver's tables, each with the DuckDB SQL of the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranking, text, timeexpr
from ..operators import chunking, extraction, graph, reports, retrieval, vector, window
from ..sources import files, stores
from ..sources.catalog import Catalog
from . import costs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- the two graphs that the tables give


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of customers and brands by quarter of shipment."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.least("c_name", "p_brand").alias("src"),
        F.greatest("c_name", "p_brand").alias("tgt"),
        F.concat("l_returnflag", "l_linestatus").alias("description"),
        timeexpr.format_level(F.col("l_shipdate"), "quarter").alias("ts"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("chunk_id"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("seq"),
    )


TRADE = """trade AS (
  SELECT least(c_name, p_brand) AS src, greatest(c_name, p_brand) AS tgt, l_returnflag || l_linestatus AS description,
         year(l_shipdate) || '-Q' || quarter(l_shipdate) AS ts, 'order-' || o_orderkey AS chunk_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""
FACTS = TRADE + """, facts AS (
  SELECT src, tgt, ts, arg_max(description, seq) AS description, arg_max(chunk_id, seq) AS chunk_id FROM trade GROUP BY src, tgt, ts)"""
EDGES = FACTS + ", edges AS (SELECT DISTINCT src, tgt FROM facts)"
DEGREES = EDGES + """, degrees AS (
  SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT tgt FROM edges) GROUP BY node)"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.merge_temporal_facts(trade(spark, sf)).drop("seq")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).select("src", "tgt").distinct()


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of users and kinds of events by day."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("USER "), F.col("user_id").cast("string")).alias("src"), F.upper("event_type").alias("tgt"), F.date_format("ts", "yyyy-MM-dd").alias("ts"), F.col("props").alias("description"), F.col("event_id").cast("string").alias("chunk_id"), F.col("event_id").alias("seq")
    )


DAILY = """daily AS (SELECT 'USER ' || user_id AS src, upper(event_type) AS tgt, strftime(ts, '%Y-%m-%d') AS ts, props AS description, event_id::VARCHAR AS chunk_id, event_id AS seq FROM events)"""
TH = DAILY + """, chain AS (
  SELECT ts, chunk_id, [{'k': 'YEAR', 't': substr(ts, 1, 4)}, {'k': 'QUARTER', 't': substr(ts, 1, 4) || '-Q' || ((substr(ts, 6, 2)::INT + 2) // 3)}, {'k': 'MONTH', 't': substr(ts, 1, 7)}, {'k': 'DATE', 't': ts}] AS path FROM daily),
th_edges AS (SELECT DISTINCT path[i].t AS parent, path[i + 1].t AS child, path[i].k || '->' || path[i + 1].k AS description FROM chain, range(1, 4) r(i)),
th_nodes AS (SELECT DISTINCT path[i].t AS ts, i - 1 AS level, path[i].k AS entity_type FROM chain, range(1, 5) r(i)),
reach AS (SELECT DISTINCT path[i].t AS ancestor, path[j].t AS descendant FROM chain, range(1, 5) a(i), range(1, 5) b(j) WHERE i < j)"""


def tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = graph.hierarchy(daily(spark, sf).select("ts"))
    return nodes, graph.cut_lineage(edges)


def catalog(spark: SparkSession) -> Catalog:
    """A fresh store in the shared folder."""
    return Catalog(spark, f"{graph.checkpoint_dir(spark)}/chronolith-store-{uuid.uuid4().hex[:12]}")


def rounded(column, digits: int = 6):  # noqa: ANN001, ANN201
    return F.round(column, digits)


# ---------------------------------------------------------------- flagship


@query(
    "e0_time_window_evidence",
    f"""WITH {DEGREES}, inside AS (SELECT * FROM facts WHERE substr(ts, 1, 4) = '1996'),
scored AS (SELECT chunk_id, sum(s.degree + t.degree)::BIGINT AS score FROM inside JOIN degrees s ON src = s.node JOIN degrees t ON tgt = t.node GROUP BY chunk_id),
ranked AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rn FROM scored),
top AS (SELECT chunk_id, score, 40 AS tokens, rn FROM ranked WHERE rn <= 200)
SELECT chunk_id, score, tokens FROM (SELECT *, sum(tokens) OVER (ORDER BY rn) AS total FROM top) WHERE total <= 4000""",
)
def time_window_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Which orders best support the year 1996: facts in it, scored by degrees, within a token budget."""
    f = facts(spark, sf)
    d = graph.degrees(edges(spark, sf))
    inside = f.where(timeexpr.parent_time(F.col("ts"), "year") == "1996")
    scored = inside.join(d.toDF("src", "ds"), "src").join(d.toDF("tgt", "dt"), "tgt").groupBy("chunk_id").agg(F.sum(F.col("ds") + F.col("dt")).alias("score"))
    best = window.top_k(scored, [F.desc("score"), F.col("chunk_id")], 200).withColumn("tokens", F.lit(40))
    return window.token_budget(best, "tokens", [F.desc("score"), F.col("chunk_id")], 4000)


# ---------------------------------------------------------------- sources and sinks


@query(
    "s5_corpus_adapter",
    """SELECT CASE WHEN doc_id % 4 = 0 THEN source ELSE source || ' ' || (2020 + doc_id % 5) || CASE WHEN doc_id % 4 = 1 THEN '' ELSE ' Q' || (doc_id % 4) END END AS title, md5(text) AS doc_md5, doc_id % 3 = 0 AS raw
FROM documents""",
)
def corpus_adapter(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 4
    rows = table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("cleaned_content"),
        F.col("text").alias("raw_content"),
        F.col("source").alias("company_name"),
        F.when(k > 0, (2020 + F.col("doc_id") % 5).cast("string")).alias("year"),
        F.when(k > 1, F.concat(F.lit("q"), k.cast("string"))).alias("quarter"),
    )
    made = files.as_documents(rows.withColumn("raw_content", F.col("raw_content")))
    flags = table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("doc_md5"), (F.col("doc_id") % 3 == 0).alias("raw"), "doc_id", "source")
    keyed = made.select("title", F.md5(F.col("doc").cast("binary")).alias("doc_md5"))
    k2 = F.col("doc_id") % 4
    year = (2020 + F.col("doc_id") % 5).cast("string")
    flags = flags.withColumn("title", F.when(k2 == 0, F.col("source")).when(k2 == 1, F.concat_ws(" ", "source", year)).otherwise(F.concat_ws(" ", "source", year, F.concat(F.lit("Q"), k2.cast("string")))))
    return flags.join(keyed.distinct(), ["title", "doc_md5"]).select("title", "doc_md5", "raw")


@query("s7_graph_load", """SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events""")
def graph_load(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes stored as JSON become maps again."""
    kept = stores.restored(stores.stored(table(spark, sf, "events").select("event_id", "props")), ["props"])
    return kept.select(F.col("event_id").cast("bigint").alias("event_id"), F.element_at("props", "k").cast("int").alias("k"))


@query("s8_vector_load", "SELECT vec_id, len(embedding)::INT AS dims, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def vector_load(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("dims"), rounded(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("k2_kv_upsert", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def kv_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return window.last_write(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@query("k3_kv_truncate", "SELECT count(*) AS before, 0::BIGINT AS after, count(*) AS new_keys FROM documents")
def kv_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table before and after it is emptied, and how many rows are new to it then."""
    c = catalog(spark)
    rows = table(spark, sf, "documents").select("doc_id")
    c.write("docs", rows)
    before = c.read("docs").agg(F.count(F.lit(1)).alias("before"))
    c.truncate("docs")
    after = c.read("docs").agg(F.count(F.lit(1)).alias("after"))
    return before.crossJoin(after).crossJoin(c.new_keys("docs", rows, "doc_id").agg(F.count(F.lit(1)).alias("new_keys")))


@query(
    "k4_clean_attributes",
    """SELECT event_id::VARCHAR AS event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS event_type, '{"a":"' || event_type || '"}' AS packed FROM events""",
)
def clean_attributes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return stores.stored(e.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"), F.create_map(F.lit("a"), F.col("event_type")).alias("packed")))


@query(
    "k8_node_upsert",
    """WITH o AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE upper(c_name) END AS name FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, o.seg FROM o FULL OUTER JOIN n ON o.id = n.id""",
)
def node_upsert(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.upper("c_name")).alias("name"))
    return graph.upsert(old, new, ["id"])


@query(
    "k9_edge_upsert_endpoints",
    f"""WITH {EDGES} SELECT DISTINCT node AS entity_name, 'UNKNOWN' AS entity_type, '' AS description, '' AS source_id
FROM (SELECT src AS node FROM edges UNION SELECT tgt FROM edges) WHERE node NOT IN (SELECT c_name FROM customer WHERE c_custkey % 2 = 0)""",
)
def edge_upsert_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_name").alias("entity_name"))
    return graph.missing_endpoints(nodes, edges(spark, sf))


# ---------------------------------------------------------------- filters and lookups


@query("f1_new_keys", "SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def new_keys(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", text.hash_id(F.col("text"), "doc-").alias("id"))
    return d.join(d.where("doc_id % 2 = 0").select("id"), "id", "left_anti").select("doc_id")


@query(
    "f2_get_by_ids",
    """WITH ids(pos, id) AS (VALUES (0, 5), (1, 999999999), (2, 17), (3, 1)) SELECT pos::INT AS pos, id::BIGINT AS doc_id, lang, source FROM ids LEFT JOIN documents ON doc_id = id""",
)
def get_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.catalog import by_ids

    ids = spark.sql("SELECT * FROM VALUES (0, 5L), (1, 999999999L), (2, 17L), (3, 1L) AS t(pos, doc_id)")
    return by_ids(table(spark, sf, "documents"), ids, "doc_id", "pos", ["lang", "source"]).select("pos", "doc_id", "lang", "source")


@query("f3_all_keys", "SELECT 'doc-' || md5(text) AS id FROM documents GROUP BY 1")
def all_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(text.hash_id(F.col("text"), "doc-").alias("id")).distinct()


@query(
    "f4_has_edge",
    f"""WITH {EDGES} SELECT c_name, p_brand FROM (SELECT DISTINCT c_name FROM customer) CROSS JOIN (SELECT DISTINCT p_brand FROM part)
WHERE EXISTS (SELECT 1 FROM edges WHERE src = least(c_name, p_brand) AND tgt = greatest(c_name, p_brand))""",
)
def has_edge(spark: SparkSession, sf: str) -> DataFrame:
    """Which pairs of a customer and a brand are edges: the edges between them, of course."""
    wanted = table(spark, sf, "customer").select("c_name").distinct()
    both = graph.symmetric(edges(spark, sf)).toDF("c_name", "p_brand")
    brands = table(spark, sf, "part").select("p_brand").distinct()
    return both.join(wanted, "c_name", "left_semi").join(brands, "p_brand", "left_semi").select("c_name", "p_brand").distinct()


@query("f5_get_edge", f"WITH {FACTS} SELECT ts, description, chunk_id FROM facts WHERE src = 'Brand#11' AND tgt = (SELECT min(c_name) FROM customer)")
def get_edge(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "customer").agg(F.min("c_name").alias("tgt"))
    return facts(spark, sf).where("src = 'Brand#11'").join(F.broadcast(first), "tgt").select("ts", "description", "chunk_id")


@query("f6_adjacent_edges", f"WITH {EDGES} SELECT src, tgt FROM edges WHERE src = 'Brand#11' OR tgt = 'Brand#11'")
def adjacent_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.incident(edges(spark, sf), F.lit("Brand#11"))


@query(
    "f7_temporal_split",
    f"""WITH {DAILY}, n AS (SELECT src AS name, 'USER' AS kind FROM daily UNION SELECT ts, 'DATE' FROM daily UNION SELECT tgt, 'EVENT' FROM daily)
SELECT kind IN ('YEAR', 'QUARTER', 'MONTH', 'DATE') AS is_temporal, count(*) AS n FROM n GROUP BY 1""",
)
def temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf)
    n = d.select(F.col("src").alias("name"), F.lit("USER").alias("kind")).union(d.select("ts", F.lit("DATE"))).union(d.select("tgt", F.lit("EVENT"))).distinct()
    return n.groupBy(F.col("kind").isin(extraction.TIME_TYPES).alias("is_temporal")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f8_temporal_cooccurrence",
    f"""WITH {DAILY}, k AS (SELECT ts AS name, true AS t FROM daily UNION SELECT tgt, true FROM daily WHERE tgt IN ('VIEW', 'CLICK') UNION SELECT tgt, false FROM daily WHERE tgt NOT IN ('VIEW', 'CLICK') UNION SELECT src, false FROM daily WHERE length(src) % 2 = 0),
e AS (SELECT DISTINCT CASE WHEN seq % 3 = 0 THEN 'NONE' ELSE ts END AS ts, src, tgt FROM daily),
j AS (SELECT e.ts, e.src, e.tgt, coalesce(a.t, false) AS a, coalesce(b.t, false) AS b, coalesce(c.t, false) AS c, coalesce(NOT a.t, false) AS na, coalesce(NOT b.t, false) AS nb, coalesce(NOT c.t, false) AS nc
FROM e LEFT JOIN k a ON a.name = e.ts LEFT JOIN k b ON b.name = e.src LEFT JOIN k c ON c.name = e.tgt),
r AS (SELECT CASE WHEN a THEN CASE WHEN nb OR nc THEN ts END WHEN b THEN CASE WHEN na OR nc THEN src END WHEN c THEN CASE WHEN na OR nb THEN tgt END END AS ts FROM j) SELECT DISTINCT ts FROM r WHERE ts IS NOT NULL""",
)
def temporal_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    """Times that stay in the relation graph; here two kinds of events pass for times, and some users for nothing."""
    d = daily(spark, sf)
    odd = F.col("tgt").isin("VIEW", "CLICK")
    kinds = d.select(F.col("ts").alias("name"), F.lit(True).alias("is_temporal")).union(d.select("tgt", odd)).union(d.where(F.length("src") % 2 == 0).select("src", F.lit(False))).distinct()
    return extraction.cooccurring_times(d.withColumn("ts", F.when(F.col("seq") % 3 == 0, "NONE").otherwise(F.col("ts"))), kinds)


@query(
    "f9_quadruple_filter",
    f"""WITH {DAILY} SELECT src AS v1, tgt AS v2, description AS e, ts AS tau, chunk_id AS source_id, ts AS raw_timestamp FROM daily
WHERE trim(description) <> '' AND tgt NOT IN ('CLICK') AND src NOT IN (SELECT ts FROM daily)""",
)
def quadruple_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).withColumn("raw_timestamp", F.col("ts"))
    return extraction.quadruples(d, d.select(F.col("ts").alias("entity_name")).distinct(), metric="^CLICK$")


@query(
    "f10_f11_report_filter",
    """SELECT d.doc_id, quality FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id % 4 <= 2 AND coalesce(quality, 0) >= 1""",
)
def report_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return rows.where(F.col("doc_id") % 4 <= 2).where(F.coalesce("quality", F.lit(0)) >= 1)


@query(
    "f12_point_filter",
    """SELECT event_id AS analyst, event_type AS description, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE (event_id % 5)::DOUBLE END AS score FROM events
WHERE CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE (event_id % 5)::DOUBLE END > 0""",
)
def point_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    score = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(',"score":'), (F.col("event_id") % 5).cast("string")))
    answers = e.select(F.col("event_id").alias("group"), F.concat(F.lit('{"points":[{"description":"'), F.col("event_type"), F.lit('"'), score, F.lit("}]}")).alias("response"))
    return reports.points(answers)


@query(
    "f13_temporal_predicate",
    """SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') OR contains(text, 'with') OR contains(lower(text), 'quarter') OR contains(lower(text), 'year') OR lower(lang) IN ('year', 'quarter', 'month', 'date', 'week')""",
)
def temporal_predicate(spark: SparkSession, sf: str) -> DataFrame:
    times, sub = F.array(F.lit("src1"), F.lit("with")), F.array(F.lit("src2"))
    match = vector.temporal_match(F.col("source"), F.col("text"), F.lit(""), F.col("lang"), times, sub, ["quarter", "year"])
    return table(spark, sf, "documents").where(match).select("doc_id")


@query(
    "f15_edges_at_times",
    f"""WITH {FACTS} SELECT DISTINCT src, tgt FROM facts WHERE ts IN ('1996-Q1', '1997-Q3', 'rf') OR contains(lower(description), 'rf')""",
)
def edges_at_times(spark: SparkSession, sf: str) -> DataFrame:
    """By the keys of their maps, or by what their texts mention."""
    return retrieval.edges_at(graph.edges_with_maps(facts(spark, sf)), ["1996-Q1", "1997-Q3", "rf"]).select("src", "tgt")


@query("f17_time_closure", f"WITH {TH} SELECT src, tgt, ts, chunk_id FROM daily WHERE ts = '2024-01-05' OR ts IN (SELECT descendant FROM reach WHERE ancestor IN ('2024-01-05', '2024-01'))")
def time_closure(spark: SparkSession, sf: str) -> DataFrame:
    _, e = tree(spark, sf)
    wanted = spark.createDataFrame([("2024-01-05",), ("2024-01",)], "ts string")
    return retrieval.within_times(daily(spark, sf).select("src", "tgt", "ts", "chunk_id"), wanted, e)


@query("f18_include_exclude", "SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END, c_custkey) - 1 AS rank FROM customer")
def include_exclude(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return window.include_first(c, F.col("c_mktsegment") == "BUILDING", [F.col("c_custkey")], "rank").select("c_custkey", "rank")


@query("f20_tolerant_keys", """SELECT event_id, event_type AS key FROM events""")
def tolerant_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Six spellings of a key are one."""
    e, t = F.col("event_id") % 6, F.col("event_type")
    quoted = lambda q: F.concat(F.lit(q), t, F.lit(q))
    spelled = F.when(e == 0, t).when(e == 1, quoted('"')).when(e == 2, quoted("'")).when(e == 3, quoted("&quot;")).when(e == 4, F.concat(F.lit("&#34;"), t, F.lit('"'))).otherwise(F.concat(F.lit(" "), quoted("&#39;"), F.lit(" ")))
    return table(spark, sf, "events").select("event_id", text.sanitize(text.clean_text(spelled)).alias("key"))


# ---------------------------------------------------------------- joins


@query(
    "j3_edge_merge_join",
    f"""WITH {FACTS}, old AS (SELECT DISTINCT src, tgt FROM facts WHERE ts < '1997'), new AS (SELECT DISTINCT src, tgt FROM facts WHERE ts >= '1997')
SELECT new.src, new.tgt, old.src IS NOT NULL AS known FROM new LEFT JOIN old ON new.src = old.src AND new.tgt = old.tgt""",
)
def edge_merge_join(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    old = f.where("ts < '1997'").select("src", "tgt").distinct().withColumn("k", F.lit(True))
    return f.where("ts >= '1997'").select("src", "tgt").distinct().join(old, ["src", "tgt"], "left").select("src", "tgt", F.col("k").isNotNull().alias("known"))


@query(
    "j6_two_hops",
    f"""WITH {DAILY}, e AS (SELECT DISTINCT ts AS a, src AS b FROM daily UNION SELECT DISTINCT src, tgt FROM daily),
s AS (SELECT a AS node, b AS other FROM e UNION SELECT b, a FROM e)
SELECT DISTINCT x.node AS ts, least(y.node, y.other) AS src, greatest(y.node, y.other) AS tgt FROM s x JOIN s y ON x.other = y.node WHERE x.node IN ('2024-01-01', '2024-01-02')""",
)
def two_hops(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf)
    e = d.select(F.col("ts").alias("src"), F.col("src").alias("tgt")).union(d.select("src", "tgt")).distinct()
    return graph.two_hops(e, spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "ts string"))


@query(
    "j7_degree_join",
    f"WITH {DEGREES} SELECT src, tgt, s.degree AS ds, t.degree AS dt FROM edges JOIN degrees s ON src = s.node JOIN degrees t ON tgt = t.node",
)
def degree_join(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    d = graph.degrees(e)
    return e.join(d.toDF("src", "ds"), "src").join(d.toDF("tgt", "dt"), "tgt").select("src", "tgt", "ds", "dt")


@query(
    "j9_vector_chunk_join",
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS sim FROM embeddings, q),
r AS (SELECT vec_id, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT rank, vec_id, lang FROM r LEFT JOIN documents ON doc_id = vec_id WHERE rank <= 10""",
)
def vector_chunk_join(spark: SparkSession, sf: str) -> DataFrame:
    best = _nearest(spark, sf, 10)
    return best.join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id", "left").select("rank", "vec_id", "lang")


def _vector0(spark: SparkSession, sf: str) -> list[float]:
    return list(table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"])


def _nearest(spark: SparkSession, sf: str, k: int) -> DataFrame:
    scored = table(spark, sf, "embeddings").select("vec_id", vector.cosine(F.col("embedding"), vector.literal(_vector0(spark, sf))).alias("sim"))
    best = window.top_k(scored, [F.desc("sim"), F.col("vec_id")], k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sim"), "vec_id")).cast("bigint"))


@query(
    "j14_title_lookup",
    "SELECT d.doc_id, coalesce(p.url, 'Unknown Document') AS title FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id",
)
def title_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return table(spark, sf, "documents").select("doc_id").join(p, "doc_id", "left").select("doc_id", F.coalesce("url", F.lit("Unknown Document")).alias("title"))


@query(
    "j16_relation_counts",
    f"""WITH {EDGES}, ent AS (SELECT DISTINCT c_name AS entity FROM customer), s AS (SELECT src AS node, tgt AS other FROM edges UNION SELECT tgt, src FROM edges),
ch AS (SELECT DISTINCT src AS entity, chunk_id FROM facts UNION SELECT DISTINCT tgt, chunk_id FROM facts)
SELECT ent.entity, ch.chunk_id, count(DISTINCT s.other) AS relation_counts FROM ent JOIN ch USING (entity) LEFT JOIN ch o ON o.chunk_id = ch.chunk_id LEFT JOIN s ON s.node = ent.entity AND s.other = o.entity GROUP BY 1, 2""",
)
def relation_counts(spark: SparkSession, sf: str) -> DataFrame:
    f = graph.cut_lineage(facts(spark, sf).select("src", "tgt", "chunk_id"))
    ent = table(spark, sf, "customer").select(F.col("c_name").alias("entity")).distinct()
    chunks = f.select(F.col("src").alias("entity"), "chunk_id").union(f.select("tgt", "chunk_id")).distinct()
    return graph.relation_counts(ent, f.select("src", "tgt").distinct(), chunks).select("entity", "chunk_id", "relation_counts")


@query(
    "j19_nearest_time",
    f"""WITH {FACTS}, q(t) AS (VALUES ('1996-Q2'), ('1999')), y AS (SELECT DISTINCT src, substr(ts, 1, 4)::INT AS y FROM facts)
SELECT src, t, min(abs(y - substr(t, 1, 4)::INT))::DOUBLE AS distance FROM y, q WHERE abs(y - substr(t, 1, 4)::INT) <= 1 GROUP BY 1, 2""",
)
def nearest_time(spark: SparkSession, sf: str) -> DataFrame:
    q = spark.createDataFrame([("1996-Q2",), ("1999",)], "t string")
    own = trade(spark, sf).select("src", "ts").distinct().withColumn("y", timeexpr.extract_year(F.col("ts")))
    # two query times against all: an equi-join on the years they reach
    reach = q.select("t", F.explode(F.sequence(timeexpr.extract_year(F.col("t")) - 1, timeexpr.extract_year(F.col("t")) + 1)).alias("y"))
    pairs = own.join(F.broadcast(reach), "y").where(timeexpr.temporal_overlap(F.col("ts"), F.col("t")))
    return pairs.groupBy("src", "t").agg(F.min(timeexpr.temporal_distance(F.col("ts"), F.col("t"))).alias("distance"))


@query(
    "j20_interval_containment",
    """SELECT q, count(*) AS n FROM (SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS q FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1998-01-01') GROUP BY q""",
)
def interval_containment(spark: SparkSession, sf: str) -> DataFrame:
    dim = timeexpr.time_dim(spark, "1996-01-01", "1997-12-31").where("level = 'quarter'").select("ts", "start_date", "end_date")
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return o.join(F.broadcast(dim), F.col("day").between(F.col("start_date"), F.col("end_date"))).groupBy(F.col("ts").alias("q")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "j21_text_time_replication",
    """SELECT doc_id, 'Content from ' || t || ': ' || left(text, 20) AS content FROM documents CROSS JOIN (VALUES ('2024-Q1'), ('2024-Q2')) q(t)""",
)
def text_time_replication(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("t", F.explode(F.array(F.lit("2024-Q1"), F.lit("2024-Q2"))))
    return d.select("doc_id", F.concat(F.lit("Content from "), "t", F.lit(": "), F.left("text", F.lit(20))).alias("content"))


@query("j22_sibling_range", f"WITH {TH} SELECT ts, CASE WHEN ts < '2024-01-05' THEN 'before' ELSE 'between' END AS via FROM th_nodes WHERE level = 3 AND (ts < '2024-01-05' OR ts BETWEEN '2024-01-10' AND '2024-01-12')")
def sibling_range(spark: SparkSession, sf: str) -> DataFrame:
    n, e = tree(spark, sf)
    asked = spark.createDataFrame([("before", ["2024-01-05"], 3), ("between", ["2024-01-10", "2024-01-12"], 3)], "logic string, timestamps array<string>, level int")
    return retrieval.retrieve_times(asked, n, e)


@query(
    "j23_subset_communities",
    """WITH l AS (SELECT source AS cluster, lang AS node FROM documents WHERE doc_id % 7 = 0 GROUP BY 1, 2), u AS (SELECT source AS parent, lang AS node FROM documents GROUP BY 1, 2), n AS (SELECT cluster, count(*) AS n FROM l GROUP BY 1)
SELECT cluster, parent FROM l JOIN u USING (node) JOIN n USING (cluster) GROUP BY cluster, parent, n HAVING count(*) = n""",
)
def subset_communities(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    lower = d.where("doc_id % 7 = 0").groupBy(F.col("source").alias("cluster")).agg(F.collect_set("lang").alias("nodes"))
    upper = d.groupBy(F.col("source").alias("cluster")).agg(F.collect_set("lang").alias("nodes"))
    return graph.sub_communities(lower, upper)


# ---------------------------------------------------------------- aggregations


@query(
    "a2_a4_merge_nodes",
    """WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2),
w AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS rn FROM v)
SELECT 'USER ' || e.user_id AS entity_name, w.event_type AS entity_type, string_agg(DISTINCT e.event_type, '<SEP>' ORDER BY e.event_type) AS description, string_agg(DISTINCT (event_id % 5)::VARCHAR, '<SEP>' ORDER BY (event_id % 5)::VARCHAR) AS source_id
FROM events e JOIN w ON w.user_id = e.user_id AND rn = 1 GROUP BY e.user_id, w.event_type""",
)
def merge_nodes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    rows = e.select(F.concat(F.lit("USER "), F.col("user_id").cast("string")).alias("entity_name"), F.col("event_type").alias("entity_type"), F.col("event_type").alias("description"), (F.col("event_id") % 5).cast("string").alias("source_id"), F.col("event_id").alias("seq"))
    return graph.merge_nodes(rows)


@query(
    "a5_static_edges",
    f"""WITH {TRADE} SELECT src, tgt, sum(seq % 10)::DOUBLE AS weight, min(seq % 4)::BIGINT AS "order", string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description, string_agg(DISTINCT ts, '<SEP>' ORDER BY ts) AS source_id FROM trade GROUP BY src, tgt""",
)
def static_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = trade(spark, sf).select("src", "tgt", (F.col("seq") % 10).cast("double").alias("weight"), (F.col("seq") % 4).alias("order"), "description", F.col("ts").alias("source_id"))
    return graph.merge_static_edges(rows)


@query("a6_map_merge", f"WITH {FACTS} SELECT src, tgt, string_agg(ts || '=' || description || '@' || chunk_id, ';' ORDER BY ts) AS merged FROM facts GROUP BY src, tgt")
def map_merge(spark: SparkSession, sf: str) -> DataFrame:
    maps = graph.edges_with_maps(facts(spark, sf))
    merged = F.transform(F.array_sort(F.map_entries("description")), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit("@"), F.element_at("source_id", e["key"])))
    return maps.select("src", "tgt", F.array_join(merged, ";").alias("merged"))


@query("a7_degree", f"WITH {DEGREES} SELECT node, degree FROM degrees")
def degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(edges(spark, sf))


@query("a8_edge_degree", f"WITH {DEGREES} SELECT src, tgt, s.degree + t.degree AS edge_degree FROM edges JOIN degrees s ON src = s.node JOIN degrees t ON tgt = t.node")
def edge_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edge_degrees(edges(spark, sf))


@query(
    "a9_in_out_degree",
    f"WITH {TH} SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT parent AS node, 0 AS i, 1 AS o FROM th_edges UNION ALL SELECT child, 1, 0 FROM th_edges) GROUP BY node",
)
def in_out_degree(spark: SparkSession, sf: str) -> DataFrame:
    _, e = tree(spark, sf)
    return graph.in_out_degrees(e.select(F.col("parent").alias("src"), F.col("child").alias("tgt")))


@query(
    "a10_community_table",
    """WITH c AS (SELECT c_custkey, c_name AS node, c_mktsegment AS cluster FROM customer), ch AS (SELECT c_name AS node, o_orderkey % 97 AS chunk FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT cluster, count(DISTINCT node) AS n_nodes FROM c GROUP BY 1), k AS (SELECT cluster, count(DISTINCT chunk) AS n_chunks FROM c JOIN ch USING (node) GROUP BY 1),
e AS (SELECT a.cluster, count(DISTINCT (a.node, b.node)) AS n_edges FROM c a JOIN c b ON b.c_custkey IN (a.c_custkey + 1, a.c_custkey + 2) AND a.cluster = b.cluster GROUP BY 1)
SELECT cluster, n_nodes, coalesce(n_edges, 0) AS n_edges, n_chunks, round(n_chunks / max(n_chunks) OVER (), 6) AS occurrence FROM n JOIN k USING (cluster) LEFT JOIN e USING (cluster)""",
)
def community_table(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by segment; each is linked with the next two."""
    c = table(spark, sf, "customer")
    clusters = c.select(F.col("c_name").alias("node"), F.lit(0).alias("level"), F.col("c_mktsegment").alias("cluster"))
    chunks = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("entity"), (F.col("o_orderkey") % 97).cast("string").alias("chunk_id"))
    ahead = c.select(F.col("c_name").alias("src"), F.explode(F.array(F.col("c_custkey") + 1, F.col("c_custkey") + 2)).alias("next"))
    links = ahead.join(c.select(F.col("c_custkey").alias("next"), F.col("c_name").alias("tgt")), "next").select("src", "tgt")
    t = graph.community_table(clusters, links, chunks)
    size = lambda x: F.size(x).cast("bigint").alias(f"n_{x if x != 'chunk_ids' else 'chunks'}")
    return t.select("cluster", size("nodes"), size("edges"), size("chunk_ids"), rounded(F.col("occurrence")).alias("occurrence"))


@query(
    "a11_hierarchy_rollup",
    f"""WITH {TH}, all_reach AS (SELECT ancestor, descendant FROM reach UNION SELECT ts, ts FROM th_nodes), below AS (SELECT ancestor, d.* FROM all_reach JOIN daily d ON d.ts = descendant)
SELECT n.ts, n.level::INT AS level, (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM below b WHERE b.ancestor = n.ts UNION SELECT tgt FROM below b WHERE b.ancestor = n.ts)) AS n_nodes,
(SELECT count(*) FROM (SELECT DISTINCT ts, src, tgt FROM below b WHERE b.ancestor = n.ts)) AS n_edges, (SELECT count(DISTINCT chunk_id) FROM below b WHERE b.ancestor = n.ts) AS n_chunks,
(SELECT count(*) FROM th_edges e WHERE e.parent = n.ts) AS n_children, (SELECT count(*) FROM reach r WHERE r.ancestor = n.ts) AS n_descendants FROM th_nodes n""",
)
def hierarchy_rollup(spark: SparkSession, sf: str) -> DataFrame:
    r = graph.roll_up(daily(spark, sf).select("src", "tgt", "ts", "chunk_id"))
    size = lambda c: F.size(c).cast("bigint")
    return r.select("ts", "level", "n_nodes", "n_edges", "n_chunks", size("sub_communities").alias("n_children"), size("all_sub_communities").alias("n_descendants"))


@query("a12_cluster_occurrence", "SELECT c_mktsegment AS cluster, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY 1")
def cluster_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    clusters = c.select(F.col("c_name").alias("node"), F.col("c_mktsegment").alias("cluster"))
    return retrieval.cluster_counts(c.where("n_regionkey = 1").select(F.col("c_name").alias("node")), clusters)


@query(
    "a14_chunk_score",
    f"""WITH {DEGREES} SELECT chunk_id, round(sum(s.degree + t.degree) * product(1 + (length(f.src) % 3) / 10.0), 4) AS score FROM facts f JOIN degrees s ON f.src = s.node JOIN degrees t ON f.tgt = t.node GROUP BY chunk_id""",
)
def chunk_score(spark: SparkSession, sf: str) -> DataFrame:
    f = graph.cut_lineage(facts(spark, sf).select("src", "tgt", "chunk_id"))
    pairs = f.select("src", "tgt").distinct()
    d = graph.degrees(pairs)
    sims = pairs.withColumn("similarity", (F.length("src") % 3) / 10.0)
    return retrieval.chunk_scores(f, d, sims).select("chunk_id", rounded(F.col("score"), 4).alias("score"))


@query(
    "a15_best_similarity",
    """SELECT e.label AS seed, round(max(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS best FROM embeddings e, embeddings q WHERE q.vec_id = 0 GROUP BY 1""",
)
def best_similarity(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    sim = vector.cosine(F.col("embedding"), vector.literal(_vector0(spark, sf)))
    return e.groupBy(F.col("label").alias("seed")).agg(rounded(F.max(sim)).alias("best"))


@query("a16_year_span", f"WITH {TRADE} SELECT min(substr(ts, 1, 4)::INT) AS first, max(substr(ts, 1, 4)::INT) AS last FROM trade")
def year_span(spark: SparkSession, sf: str) -> DataFrame:
    y = timeexpr.extract_year(F.col("ts"))
    return trade(spark, sf).agg(F.min(y).alias("first"), F.max(y).alias("last"))


@query(
    "a18_entity_recall",
    """WITH g AS (SELECT DISTINCT source, lang FROM documents), f AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 5 = 0)
SELECT g.source, round(count(f.lang) / count(*), 6) AS recall FROM g LEFT JOIN f ON g.source = f.source AND g.lang = f.lang GROUP BY g.source""",
)
def entity_recall(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy("source").agg(F.collect_set("lang").alias("gold"), F.collect_set(F.when(F.col("doc_id") % 5 == 0, F.col("lang"))).alias("found"))
    return d.select("source", rounded(graph.recall(F.col("gold"), F.col("found"))).alias("recall"))


@query(
    "a19_cost_totals",
    """SELECT event_type, count(*) AS calls, sum(value)::DOUBLE AS prompt_tokens, sum(event_id % 100)::DOUBLE AS completion_tokens, sum(event_id % 7)::DOUBLE AS embedding_tokens, round(sum(value) / 1000 * 0.0015 + sum(event_id % 100) / 1000 * 0.002 + sum(event_id % 7) / 1000 * 0.00002, 6) AS cost, round(100.0 * sum((event_id % 3 = 0)::INT) / count(*), 4) AS cache_hit_pct FROM (SELECT * REPLACE (round(value, 0) AS value) FROM events) GROUP BY 1""",
)
def cost_totals(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    calls = e.select("event_type", F.round("value", 0).alias("prompt"), (F.col("event_id") % 100).alias("completion"), (F.col("event_id") % 7).alias("embedding"), (F.col("event_id") % 3 == 0).alias("hit"))
    return costs.totals(calls, ["event_type"]).withColumns({"cost": rounded(F.col("cost")), "cache_hit_pct": rounded(F.col("cache_hit_pct"), 4)})


# ---------------------------------------------------------------- windows, orders, sets


@query(
    "w1_token_budget",
    "SELECT source, doc_id, n_chars FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents) WHERE total <= 20000",
)
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return window.token_budget(d, "n_chars", [F.col("doc_id")], 20000, ["source"])


@query(
    "w2_next_fit",
    """WITH RECURSIVE o AS (SELECT page_id, length(html) AS tokens, row_number() OVER (ORDER BY page_id) AS n FROM pages),
g AS (SELECT n, page_id, tokens, tokens AS used, 0 AS grp FROM o WHERE n = 1 UNION ALL
SELECT o.n, o.page_id, o.tokens, CASE WHEN g.used + o.tokens > 30000 THEN o.tokens ELSE g.used + o.tokens END, CASE WHEN g.used + o.tokens > 30000 THEN g.grp + 1 ELSE g.grp END FROM g JOIN o ON o.n = g.n + 1)
SELECT page_id::VARCHAR AS ts, tokens, grp::INT AS "group" FROM g""",
)
def next_fit(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("ts"), F.length("html").cast("bigint").alias("tokens"), "page_id")
    return reports.report_groups(p, [F.col("page_id")], 30000)


@query("w3_enumeration", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS id FROM orders")
def enumeration(spark: SparkSession, sf: str) -> DataFrame:
    return window.enumerate_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "id")


@query("w4_first_seen", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return window.first_seen(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.col("event_id")])


@query(
    "w5_round_robin",
    """WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer) SELECT p::INT AS rank, (p % 5)::INT AS list_id, c_custkey AS key FROM c WHERE p < 30""",
)
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    """Five lists that hold all customers alike: each turn, a list gives what the ones before it haven't given yet."""
    c = table(spark, sf, "customer").select(F.explode(F.array(*map(F.lit, range(5)))).alias("list_id"), F.col("c_custkey").alias("key"))
    ranked = c.withColumn("pos", F.row_number().over(Window.partitionBy("list_id").orderBy("key")))
    return window.round_robin(ranked, "list_id", "pos", "key", 30).select("rank", "list_id", "key")


@query(
    "w7_overlap",
    """WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS toks FROM documents), c AS (SELECT doc_id, i // 50 AS idx, toks[i + 1:i + 50] AS toks FROM t, range(0, len(toks), 50) r(i)),
l AS (SELECT *, lag(toks) OVER (PARTITION BY doc_id ORDER BY idx) AS before FROM c)
SELECT doc_id AS full_doc_id, idx::INT AS chunk_order_index, md5(array_to_string(CASE WHEN before IS NULL THEN toks ELSE list_concat(before[greatest(1, len(before) - 9):], toks)[1:55] END, ' ')) AS content_md5 FROM l""",
)
def overlap(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunking.token_windows(table(spark, sf, "documents"), 50, 0).withColumn("toks", F.split("content", " "))
    out = chunking.with_overlap(chunks, 55, 10)
    return out.select("full_doc_id", "chunk_order_index", F.md5(F.array_join("toks", " ").cast("binary")).alias("content_md5"))


@query("w8_best_in_group", "SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS c_custkey FROM customer GROUP BY 1")
def best_in_group(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("c_custkey"))


@query(
    "t1_vector_top_k",
    """SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 20""",
)
def vector_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf, 20).select("vec_id", rounded(F.col("sim")).alias("similarity"))


@query(
    "t4_t5_report_order",
    """WITH r AS (SELECT page_id, page_id % 4 AS level, length(html) % 50 AS n_edges, length(url) AS n_nodes, page_id % 11 AS rating FROM pages), f AS (SELECT * FROM r WHERE level <= 2 ORDER BY level, n_edges DESC, n_nodes DESC, page_id LIMIT 100)
SELECT page_id, row_number() OVER (ORDER BY n_edges DESC, n_nodes DESC, rating DESC, page_id) AS rank FROM f WHERE rating >= 3""",
)
def report_order(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    r = p.select(F.col("page_id").alias("ts"), (F.col("page_id") % 4).alias("level"), (F.length("html") % 50).alias("n_edges"), F.length("url").alias("n_nodes"), (F.col("page_id") % 11).alias("rating"))
    picked = reports.select_reports(r, 2, 3, 100)
    return picked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_edges"), F.desc("n_nodes"), F.desc("rating"), "ts")).cast("bigint")).select(F.col("ts").alias("page_id"), "rank")


@query("t7_nodes_by_degree", f"WITH {DEGREES} SELECT node, degree FROM degrees ORDER BY degree DESC, node LIMIT 25")
def nodes_by_degree(spark: SparkSession, sf: str) -> DataFrame:
    return window.top_k(graph.degrees(edges(spark, sf)), [F.desc("degree"), F.col("node")], 25)


@query("t13_temporal_edges_top", f"WITH {TRADE} SELECT src, tgt, sum(seq % 10)::DOUBLE AS weight, min(seq % 4)::BIGINT AS \"order\" FROM trade WHERE ts = '1996-Q2' GROUP BY 1, 2 ORDER BY weight DESC, \"order\" DESC, src, tgt LIMIT 30")
def temporal_edges_top(spark: SparkSession, sf: str) -> DataFrame:
    t = trade(spark, sf).where("ts = '1996-Q2'").groupBy("src", "tgt").agg(F.sum((F.col("seq") % 10).cast("double")).alias("weight"), F.min(F.col("seq") % 4).alias("order"))
    return window.top_k(t, [F.desc("weight"), F.desc("order"), F.col("src"), F.col("tgt")], 30)


@query("t14_chronological", f"WITH {TRADE} SELECT ts, row_number() OVER (ORDER BY ts) AS rank FROM (SELECT DISTINCT ts FROM trade)")
def chronological(spark: SparkSession, sf: str) -> DataFrame:
    t = trade(spark, sf).select("ts").distinct()
    return t.withColumn("rank", F.row_number().over(Window.orderBy(timeexpr.time_start(F.col("ts")))).cast("bigint"))


@query("t17_stable_graph_order", f"WITH {EDGES} SELECT src, tgt FROM edges ORDER BY src || ' -> ' || tgt")
def stable_graph_order(spark: SparkSession, sf: str) -> DataFrame:
    return graph.stable_order(edges(spark, sf))


@query("t18_single", "SELECT page_id FROM (SELECT page_id, page_id % 11 AS rating, length(html) % 50 + length(url) AS size FROM pages) ORDER BY rating DESC, size DESC, page_id LIMIT 1")
def single(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "pages").select(F.col("page_id").alias("ts"), (F.col("page_id") % 11).alias("rating"), (F.length("html") % 50).alias("n_edges"), F.length("url").alias("n_nodes"))
    return reports.single(r).select(F.col("ts").alias("page_id"))


@query("u3_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def difference(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query(
    "u6_fallback_union",
    """WITH s AS (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings e, embeddings q WHERE q.vec_id = 0),
h AS (SELECT vec_id, sim, true AS matched FROM s WHERE vec_id = 7 ORDER BY sim DESC, vec_id LIMIT 5), o AS (SELECT vec_id, sim, false AS matched FROM s WHERE vec_id <> 7 ORDER BY sim DESC, vec_id LIMIT 5)
SELECT vec_id, matched FROM (SELECT * FROM h UNION ALL SELECT * FROM o) ORDER BY matched DESC, sim DESC, vec_id LIMIT 5""",
)
def fallback_union(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return vector.temporal_query(v, _vector0(spark, sf), F.col("vec_id") == 7, 5, "vec_id").select("vec_id", "matched")


# ---------------------------------------------------------------- chunks, records


@query(
    "c1_token_windows",
    """WITH t AS (SELECT doc_id, source, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS toks FROM documents)
SELECT doc_id AS full_doc_id, (i // 49)::INT AS chunk_order_index, least(60, len(toks) - i + 1)::INT AS tokens, md5(array_to_string(list_concat([source], toks[i + 1:i + 59]), ' ')) AS content_md5 FROM t, range(0, len(toks), 49) r(i)""",
)
def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.token_windows(table(spark, sf, "documents"), 60, 10, title=F.col("source"))
    return c.select("full_doc_id", "chunk_order_index", "tokens", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("c2_separator_chunks")
def separator_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.separator_chunks(table(spark, sf, "documents"), ["the", "de la", "und"], 60, 10)
    return c.select("full_doc_id", "chunk_order_index", "tokens", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(
    "c4_keyed_chunks",
    """WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS toks FROM documents), c AS (SELECT doc_id, i // 100 AS idx, array_to_string(toks[i + 1:i + 100], ' ') AS content FROM t, range(0, len(toks), 100) r(i))
SELECT 'chunk-' || md5(content) AS chunk_id, max(doc_id) AS full_doc_id FROM c GROUP BY content""",
)
def keyed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.keyed_chunks(chunking.token_windows(table(spark, sf, "documents"), 100, 0)).select("chunk_id", "full_doc_id")


@query("c5_token_count", "SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))::INT AS tokens FROM documents")
def token_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.token_count(F.col("text")).alias("tokens"))


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """A response per order: its facts in the record grammar, every fifth without a time."""
    t = trade(spark, sf)
    entity = F.concat(F.lit('("entity"<|>'), F.lower("tgt"), F.lit("<|>company<|>"), F.col("description"), F.lit(")"))
    time = F.when(F.col("seq") % 5 == 0, F.lit("")).otherwise(F.concat(F.concat(F.lit("Q"), F.right("ts", F.lit(1)), F.lit(" "), F.left("ts", F.lit(4))), F.lit("<|>")))
    relation = F.concat(F.lit('("relationship"<|>'), time, F.lower("src"), F.lit("<|>"), F.lower("tgt"), F.lit("<|>"), F.col("description"), F.lit(")"))
    rows = t.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat(entity, F.lit("##"), relation).alias("r")))).alias("rs"))
    return rows.select("chunk_id", F.concat(F.array_join(F.transform("rs", lambda x: x["r"]), "##"), F.lit("<|COMPLETE|>")).alias("response"))


@query("x1_x3_entities", f"WITH {TRADE} SELECT chunk_id, tgt AS entity_name, 'COMPANY' AS entity_type, description, count(*) AS n FROM (SELECT chunk_id, upper(tgt) AS tgt, description FROM trade) GROUP BY ALL")
def parsed_entities(spark: SparkSession, sf: str) -> DataFrame:
    parsed = extraction.records(_responses(spark, sf), "chunk_id", "response")
    return extraction.entities(parsed, "chunk_id").groupBy("chunk_id", "entity_name", "entity_type", "description").agg(F.count(F.lit(1)).alias("n"))


@query(
    "x4_x5_relations",
    f"""WITH {TRADE} SELECT chunk_id, upper(src) AS src, upper(tgt) AS tgt, CASE WHEN seq % 5 = 0 THEN 'UNKNOWN_TIME' ELSE ts END AS ts, CASE WHEN seq % 5 = 0 THEN 'mined' ELSE 'temporal' END AS route, description, count(*) AS n FROM trade GROUP BY ALL""",
)
def parsed_relations(spark: SparkSession, sf: str) -> DataFrame:
    parsed = extraction.records(_responses(spark, sf), "chunk_id", "response")
    return extraction.relations(parsed, "chunk_id").groupBy("chunk_id", "src", "tgt", "ts", "route", "description").agg(F.count(F.lit(1)).alias("n"))


@query(
    "x6_time_constraints",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'between' ELSE 'before' END AS logic, CASE WHEN event_id % 2 = 0 THEN '2024-01-01,' || strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d') END AS times FROM events""",
)
def time_constraints(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('("entity"<|>between<|>'), day, F.lit("<|>2024-01-01<|>date)<|COMPLETE|>"))).otherwise(F.concat(F.lit('("entity"<|>before<|>'), day, F.lit("<|>date)<|COMPLETE|>"))).alias("r"))
    c = extraction.time_constraints(extraction.records(e, "event_id", "r"), "event_id")
    return c.select("event_id", "logic", F.array_join("timestamps", ",").alias("times"))


@query(
    "x11_vector_payload",
    f"WITH {FACTS} SELECT 'rel-' || md5(src || '_' || tgt || '_' || ts) AS id, src || ' ' || tgt || ' ' || ts || ' ' || description AS content FROM facts",
)
def vector_payload(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.relation_payload(facts(spark, sf)).select("id", "content")


# ---------------------------------------------------------------- times

_STYLES = [
    ("strftime(ts, '%Y-%m-%d')", "date_format(ts, 'yyyy-MM-dd')", "strftime(ts, '%Y-%m-%d')", "date", 1.0),
    ("strftime(ts, '%B %-d, %Y')", "date_format(ts, 'MMMM d, yyyy')", "strftime(ts, '%Y-%m-%d')", "date", 0.95),
    ("strftime(ts, '%-d %b %Y')", "date_format(ts, 'd MMM yyyy')", "strftime(ts, '%Y-%m-%d')", "date", 0.95),
    ("year(ts) || '-Q' || quarter(ts)", "concat(year(ts), '-Q', quarter(ts))", "year(ts) || '-Q' || quarter(ts)", "quarter", 1.0),
    ("'q' || quarter(ts) || ' ' || year(ts)", "concat('q', quarter(ts), ' ', year(ts))", "year(ts) || '-Q' || quarter(ts)", "quarter", 0.6),
    ("year(ts)::VARCHAR", "cast(year(ts) AS string)", "year(ts)::VARCHAR", "year", 1.0),
    ("'FY ' || year(ts)", "concat('FY ', year(ts))", "year(ts) || '-07'", "month", 0.8),
    ("strftime(ts, '%B %Y')", "date_format(ts, 'MMMM yyyy')", "strftime(ts, '%Y-%m')", "month", 0.7),
    ("strftime(ts, '%Y-%m')", "date_format(ts, 'yyyy-MM')", "strftime(ts, '%Y-%m')", "month", 1.0),
    ("'in the year ' || year(ts)", "concat('in the year ', year(ts))", "year(ts)::VARCHAR", "year", 0.5),
    ("'Q1-Q3 ' || year(ts)", "concat('Q1-Q3 ', year(ts))", "year(ts) || '-Q1,' || year(ts) || '-Q2,' || year(ts) || '-Q3'", "quarter", 0.9),
    ("'nothing'", "'nothing'", "''", "unknown", 0.0),
    ("'this year'", "'this year'", "'2024'", "year", 0.8),
    ("'last year'", "'Last Year'", "'2023'", "year", 0.8),
    ("'current quarter'", "'current quarter'", "'2024-Q1'", "quarter", 0.8),
]


def _case(pick: int, quote: bool = False) -> str:
    arms = " ".join(f"WHEN {i} THEN {s[pick] if not quote else repr(s[pick])}" for i, s in enumerate(_STYLES))
    return f"CASE event_id % {len(_STYLES)} {arms} END"


@query("n1_n5_normalize", f"SELECT event_id, {_case(2)} AS forms, {_case(3, True)} AS granularity, ({_case(4)})::DOUBLE AS confidence FROM events")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Each different spelling is normalised once."""
    e = table(spark, sf, "events").select("event_id", F.expr(_case(1)).alias("x"))
    r = graph.by_distinct(e, "x", "r", timeexpr.normalize_time)
    return r.select("event_id", F.array_join("r.forms", ",").alias("forms"), "r.granularity", "r.confidence")


@query(
    "n6_expansions",
    """WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders) SELECT y::VARCHAR AS ts, array_to_string(list_sort(list_concat([y::VARCHAR], list_transform(range(1, 5), lambda q: y || '-Q' || q), list_transform(range(1, 13), lambda m: y || '-' || lpad(m::VARCHAR, 2, '0'))))[1:10], ',') AS found FROM y""",
)
def time_expansions(spark: SparkSession, sf: str) -> DataFrame:
    y = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy").alias("ts")).distinct()
    return y.select("ts", F.array_join(timeexpr.expansions(F.col("ts")), ",").alias("found"))


@query(
    "n9_n11_overlap_distance",
    """WITH t AS (SELECT DISTINCT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS a FROM orders), q(b) AS (VALUES ('1996-Q1'), ('1998'), ('no time'))
SELECT a, b, CASE WHEN b = 'no time' THEN false ELSE abs(substr(a, 1, 4)::INT - substr(b, 1, 4)::INT) <= 1 END AS overlap, CASE WHEN b = 'no time' THEN 10.0 ELSE abs(substr(a, 1, 4)::INT - substr(b, 1, 4)::INT)::DOUBLE END AS distance FROM t, q""".replace("substr(b, 1, 4)::INT", "try_cast(substr(b, 1, 4) AS INT)"),
)
def overlap_distance(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").select(timeexpr.format_level(F.col("o_orderdate"), "quarter").alias("a")).distinct()
    t = t.withColumn("b", F.explode(F.array(F.lit("1996-Q1"), F.lit("1998"), F.lit("no time"))))
    return t.select("a", "b", timeexpr.temporal_overlap(F.col("a"), F.col("b")).alias("overlap"), timeexpr.temporal_distance(F.col("a"), F.col("b")).alias("distance"))


@query(
    "n12_basic_normalize",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN year(ts) || '-Q' || quarter(ts) WHEN 2 THEN year(ts) || '-04' ELSE 'x' || event_id END AS ts FROM events""",
)
def basic_normalize(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.date_format("ts", "yyyy-M-d")).when(k == 1, F.concat(F.lit('"q'), F.quarter("ts"), F.lit(" "), F.year("ts"), F.lit('"'))).when(k == 2, F.concat(F.lit("Spring "), F.year("ts"))).otherwise(F.concat(F.lit("x"), F.col("event_id")))
    return e.select("event_id", timeexpr.basic_normalize(raw).alias("ts"))


@query(
    "n14_n15_parents",
    """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) SELECT strftime(d, '%Y-%m-%d') AS ts, strftime(d, '%Y') AS y, year(d) || '-Q' || quarter(d) AS q, strftime(d, '%Y-%m') AS m, isoyear(d) || '-W' || lpad(week(d)::VARCHAR, 2, '0') AS w FROM d""",
)
def parents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts")).distinct()
    return d.select("ts", *[timeexpr.parent_time(F.col("ts"), lv).alias(lv[0]) for lv in ("year", "quarter", "month", "week")])


@query(
    "n17_series",
    """SELECT c_custkey, array_to_string(list_transform(range(0, 1 + c_custkey % 9), lambda i: strftime(date '1999-11-01' + to_months(i::INT), '%Y-%m')), ',') AS months FROM customer""",
)
def series(spark: SparkSession, sf: str) -> DataFrame:
    last = F.date_format(F.add_months(F.to_date(F.lit("1999-11-01")), (F.col("c_custkey") % 9).cast("int")), "yyyy-MM")
    return table(spark, sf, "customer").select("c_custkey", F.array_join(timeexpr.time_series(F.lit("1999-11"), last, "month"), ",").alias("months"))


@query("n20_hierarchy", f"WITH {TH} SELECT parent, child, description FROM th_edges")
def hierarchy_edges(spark: SparkSession, sf: str) -> DataFrame:
    return tree(spark, sf)[1]


@query("n20_hierarchy_nodes", f"WITH {TH} SELECT n.ts, n.level::INT AS level, entity_type, n.level = 3 AS instantiation FROM th_nodes n")
def hierarchy_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return tree(spark, sf)[0].select("ts", "level", "entity_type", "instantiation")


@query("n21_closure", f"WITH {TH} SELECT ancestor, descendant FROM reach")
def closure(spark: SparkSession, sf: str) -> DataFrame:
    return graph.closure(tree(spark, sf)[1])


@query(
    "n22_retrieve_at",
    f"WITH {TH} SELECT '2024-01' AS ts, 'self' AS via UNION ALL SELECT child, 'child' FROM th_edges WHERE parent = '2024-01'",
)
def retrieve_at(spark: SparkSession, sf: str) -> DataFrame:
    n, e = tree(spark, sf)
    return retrieval.retrieve_times(spark.createDataFrame([("at", ["2024-01"], 2)], "logic string, timestamps array<string>, level int"), n, e)


@query(
    "n23_alignment",
    f"WITH {TH} SELECT '2024-Q1' AS ts UNION SELECT descendant FROM reach WHERE ancestor = '2024-Q1' AND length(descendant) = 10 UNION SELECT '2024-01-05'",
)
def alignment(spark: SparkSession, sf: str) -> DataFrame:
    _, e = tree(spark, sf)
    return retrieval.align_times(spark.createDataFrame([("2024-Q1",), ("2024-01-05",)], "ts string"), e, "date")


# ---------------------------------------------------------------- scalars


@query(
    "g1_g2_hashes",
    "SELECT doc_id, 'doc-' || md5(text) AS id, md5('{\"a0\":\"' || lang || '\",\"a1\":' || doc_id || '}') AS args FROM documents",
)
def hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.hash_id(F.col("text"), "doc-").alias("id"), text.args_hash(F.col("lang"), F.col("doc_id")).alias("args"))


def _clean_sql(column: str) -> str:
    out = f"trim({column}, E' \\t\\r\\n')"
    for reference, character in (text.NAMED | text.REFERENCES).items():
        out = f"replace({out}, '{reference}', '{character.replace(chr(39), chr(39) * 2)}')"
    return rf"regexp_replace({out}, '[\x00-\x1f\x7f-\x{{9f}}]', '', 'g')"


@query("g3_clean_text", f"SELECT page_id, md5({_clean_sql('html')}) AS clean_md5 FROM pages")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(text.clean_text(F.col("html")).cast("binary")).alias("clean_md5"))


@query("g4_split_markers", "SELECT doc_id, len(list_filter(string_split_regex(text, '\\n|, '), lambda x: trim(x, E' \\t\\r\\n') <> ''))::INT AS parts FROM documents")
def split_markers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(text.split_markers(F.col("text"), ["\n", ", "])).alias("parts"))


@query("g5_g7_quotes", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE '"' || event_type || '"' END AS quoted, event_id % 2 = 0 AS number FROM events""")
def quotes(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", text.quoted(raw).alias("quoted"), text.is_number(raw).alias("number"))


@query("g6_csv", """SELECT n_regionkey, string_agg(n_nationkey || E',\\t"' || n_name || '"', E'\\n' ORDER BY n_nationkey) AS csv FROM nation GROUP BY 1""")
def csv(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").withColumn("line", text.csv_row(F.col("n_nationkey"), F.col("n_name")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"])
    return n.groupBy("n_regionkey").agg(F.array_join(lines, "\n").alias("csv"))


@query("g8_g9_json", """SELECT event_id, (props::JSON ->> 'k') AS strict, (props::JSON ->> 'k') AS loose FROM events""")
def json_functions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    broken = F.concat(F.lit("Sure: "), F.regexp_replace("props", "\\}$", ","))
    return e.select("event_id", text.to_json_map(F.col("props"))["k"].alias("strict"), text.to_json_map(broken)["k"].alias("loose"))


@query(
    "g10_parse_value",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN 'bool' WHEN 2 THEN 'int' WHEN 3 THEN 'float' ELSE 'string' END AS kind, CASE event_id % 5 WHEN 2 THEN event_id::DOUBLE WHEN 3 THEN event_id + 0.5 END::DOUBLE AS number FROM events""",
)
def parse_value(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.lit("None")).when(k == 1, F.lit("True")).when(k == 2, F.col("event_id").cast("string")).when(k == 3, F.concat(F.col("event_id").cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    v = text.parse_value(raw)
    return table(spark, sf, "events").select("event_id", v["kind"].alias("kind"), v["number"].alias("number"))


@query(
    "g11_report_text",
    r"""SELECT page_id, '# ' || url || E'\n\nsummary\n\n## one\n\n' || page_id || E'\n\n## two\n\nrest' AS report FROM pages""",
)
def report_text(spark: SparkSession, sf: str) -> DataFrame:
    findings = F.array(F.struct(F.lit("one").alias("summary"), F.col("page_id").cast("string").alias("explanation")), F.struct(F.lit("two").alias("summary"), F.lit("rest").alias("explanation")))
    return table(spark, sf, "pages").select("page_id", text.report_text(F.col("url"), F.lit("summary"), findings).alias("report"))


@query("g14_describe_map", f"WITH {FACTS} SELECT src, tgt, string_agg(ts || ': ' || description, '; ' ORDER BY ts) AS described FROM facts GROUP BY 1, 2")
def describe_map(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges_with_maps(facts(spark, sf)).select("src", "tgt", text.describe_map(F.col("description")).alias("described"))


@query(
    "g15_query_enhancement",
    "SELECT doc_id, md5(concat_ws(' ', text, " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{'|'.join(words)}') THEN '{phrase}' END" for words, phrase in text.QUERY_FAMILIES) + ")) AS enhanced_md5 FROM documents",
)
def query_enhancement(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.enhance_query(F.col("text")).cast("binary")).alias("enhanced_md5"))


@query("g19_years", f"WITH {TRADE} SELECT src, string_agg(DISTINCT substr(ts, 1, 4), ',' ORDER BY substr(ts, 1, 4)) AS years FROM trade GROUP BY src")
def years(spark: SparkSession, sf: str) -> DataFrame:
    return trade(spark, sf).groupBy("src").agg(F.collect_set("ts").alias("t")).select("src", F.array_join(text.years_of(F.col("t")), ",").alias("years"))


# ---------------------------------------------------------------- vectors, graphs, ranks


@query(
    "v1_cosine_scan",
    """WITH s AS (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings e, embeddings q WHERE q.vec_id = 0)
SELECT vec_id, round(sim, 6) AS similarity, round(1 - sim, 6) AS distance, false AS below_threshold FROM s WHERE sim >= 0.2 ORDER BY sim DESC, vec_id LIMIT 10""",
)
def cosine_scan(spark: SparkSession, sf: str) -> DataFrame:
    hits = vector.query(table(spark, sf, "embeddings"), _vector0(spark, sf), 10, id_col="vec_id")
    return hits.select("vec_id", rounded(F.col("similarity")).alias("similarity"), rounded(F.col("distance")).alias("distance"), "below_threshold")


@query(
    "v2_temporal_vector",
    """WITH s AS (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id % 10 = 3) SELECT vec_id, true AS matched FROM s ORDER BY sim DESC, vec_id LIMIT 5""",
)
def temporal_vector(spark: SparkSession, sf: str) -> DataFrame:
    return vector.temporal_query(table(spark, sf, "embeddings"), _vector0(spark, sf), F.col("vec_id") % 10 == 3, 5, "vec_id").select("vec_id", "matched")


@query("v3_approximate_neighbours")
def approximate_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of every hundredth vector among all vectors; by hashing, half of them would be lost."""
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    return vector.exact_neighbours(e, e.where("id % 100 = 0"), 10).select("query_id", "id", "rank")


_PPR_STEPS = 10


def _ppr_sql() -> str:
    steps = [f"WITH {TRADE}, e AS (SELECT DISTINCT src, tgt FROM trade), arcs0 AS (SELECT src, tgt FROM e UNION ALL SELECT tgt, src FROM e), deg AS (SELECT src, count(*) AS d FROM arcs0 GROUP BY src), arcs AS MATERIALIZED (SELECT a.src, a.tgt, 1.0 / d AS p FROM arcs0 a JOIN deg USING (src)),"]
    steps.append("nodes AS MATERIALIZED (SELECT DISTINCT src AS node FROM arcs), seeds AS (SELECT node, 1.0 / (SELECT count(*) FROM nodes WHERE node LIKE 'Brand#1%') AS s FROM nodes WHERE node LIKE 'Brand#1%'), base AS MATERIALIZED (SELECT node, coalesce(s, 0)::DOUBLE AS s FROM nodes LEFT JOIN seeds USING (node)),")
    steps.append("r0 AS MATERIALIZED (SELECT node, s, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS x FROM base)")
    for i in range(1, 61):
        steps.append(f", g{i} AS (SELECT tgt AS node, sum(x * p) AS got FROM arcs JOIN r{i - 1} ON arcs.src = r{i - 1}.node GROUP BY tgt), r{i} AS MATERIALIZED (SELECT b.node, b.s, 0.85 * coalesce(got, 0) + 0.15 * b.s AS x FROM base b LEFT JOIN g{i} USING (node))")
    return " ".join(steps) + " SELECT node, round(x, 4) AS score FROM r60"


@query("p1_personalized_pagerank", _ppr_sql())
def personalized_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    e = graph.cut_lineage(edges(spark, sf))
    seeds = graph.symmetric(e).select("node").where("node LIKE 'Brand#1%'").distinct()
    return graph.personalized_pagerank(e, seeds, tol=1e-8).select("node", rounded(F.col("score"), 4).alias("score"))


@query("p3_ppr_evidence")
def ppr_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks for one brand's relations in 1996."""
    f = graph.cut_lineage(facts(spark, sf))
    hits = f.where("src = 'Brand#11'").withColumn("similarity", 1.0 / (1 + F.pmod(F.xxhash64("tgt"), F.lit(100)))).select("src", "tgt", "ts", "similarity")
    times = spark.createDataFrame([("1996",)], "ts string")
    _, e = graph.hierarchy(f)
    return retrieval.evidence(f, hits, times, graph.cut_lineage(e), 20).select("chunk_id", rounded(F.col("score"), 6).alias("score"))


@query("p4_communities")
def communities(spark: SparkSession, sf: str) -> DataFrame:
    return graph.communities(daily(spark, sf).select("src", "tgt").distinct())


@query(
    "p5_largest_component",
    """WITH e AS (SELECT DISTINCT 'A' || o_custkey % 40 AS a, 'B' || o_custkey % 40 || '-' || o_orderkey % 7 AS b FROM orders), c AS (SELECT a, count(DISTINCT b) AS n FROM e GROUP BY a),
best AS (SELECT a FROM c ORDER BY n DESC, a LIMIT 1) SELECT a AS src, b AS tgt FROM e WHERE a = (SELECT a FROM best)""",
)
def largest_component(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("o_custkey") % 40).cast("string")
    e = table(spark, sf, "orders").select(F.concat(F.lit("a"), k).alias("src"), F.concat(F.lit("b"), k, F.lit("-"), (F.col("o_orderkey") % 7).cast("string")).alias("tgt")).distinct()
    return graph.largest_component(e).select("src", "tgt")


@query(
    "r1_ranking_config",
    """SELECT kind, round(a / (a + p + (1 - a - p)), 6) AS alignment, round(p, 6) AS proximity, round((1 - a - p) * 0.6, 6) AS degree, round((1 - a - p) * 0.4, 6) AS relevance
FROM (SELECT kind, least(a * 1.2, 0.6) AS a, least(p * 1.1, 0.4) AS p FROM (VALUES ('general', 0.3::DOUBLE, 0.2::DOUBLE), ('temporal', 0.5, 0.3), ('enumeration', 0.25, 0.2), ('comparison', 0.35, 0.25)) t(kind, a, p))""",
)
def ranking_config(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(k, *(round(ranking.ranking_config(k)[x], 6) for x in ("alignment", "proximity", "degree", "relevance"))) for k in ranking.PRESETS]
    return spark.createDataFrame(rows, "kind string, alignment double, proximity double, degree double, relevance double")


@query(
    "r2_entity_rank",
    f"""WITH {DEGREES}, own AS (SELECT node, list(DISTINCT substr(ts, 1, 4)::INT) AS ys FROM (SELECT src AS node, ts FROM facts UNION SELECT tgt, ts FROM facts) GROUP BY node),
f AS (SELECT node, (len(list_filter(ys, lambda y: abs(y - 1996) <= 1)) > 0)::INT AS hit1, (len(list_filter(ys, lambda y: abs(y - 2001) <= 1)) > 0)::INT AS hit2, list_min(list_transform(ys, lambda y: abs(y - 1996))) AS d1, list_min(list_transform(ys, lambda y: abs(y - 2001))) AS d2 FROM own)
SELECT node, round((hit1 + hit2) / 2.0 * 0.4 + CASE WHEN hit1 + hit2 > 0 THEN (greatest(0, 1 - d1 / 10) + greatest(0, 1 - d2 / 10)) / 2 ELSE 0 END * 0.3 + least(degree / 100.0, 1) * 0.2 + CASE WHEN contains(lower(node), 'brand#1') THEN 1.0 WHEN contains(lower(node), 'x') THEN 0.5 ELSE 0 END * 0.1, 6) AS rank
FROM f JOIN degrees USING (node)""",
)
def entity_rank(spark: SparkSession, sf: str) -> DataFrame:
    f = graph.cut_lineage(facts(spark, sf))
    own = f.select(F.col("src").alias("node"), "ts").union(f.select("tgt", "ts")).groupBy("node").agg(F.collect_set("ts").alias("times"))
    d = graph.degrees(f.select("src", "tgt").distinct())
    asked = F.array(F.lit("1996"), F.lit("2001-Q1"))
    relevance = ranking.lexical_relevance(F.lit("brand#1"), F.col("node"), F.lit(""))
    rank = ranking.entity_rank(asked, F.col("times"), F.col("degree"), relevance)
    return own.join(d, "node").select("node", rounded(rank).alias("rank"))


@query(
    "r3_edge_rank",
    f"""WITH {DEGREES}, w AS (SELECT src, tgt, count(*) AS weight, list(DISTINCT substr(ts, 1, 4)::INT) AS ys FROM facts GROUP BY 1, 2),
f AS (SELECT src, tgt, weight, s.degree + t.degree AS degree, (len(list_filter(ys, lambda y: abs(y - 1996) <= 1)) > 0)::INT AS h1, (len(list_filter(ys, lambda y: abs(y - 2001) <= 1)) > 0)::INT AS h2, list_min(list_transform(ys, lambda y: abs(y - 1996))) AS d1, list_min(list_transform(ys, lambda y: abs(y - 2001))) AS d2,
CASE WHEN contains(lower(src), 'brand#1') THEN 1.0 ELSE 0 END AS rel FROM w JOIN degrees s ON src = s.node JOIN degrees t ON tgt = t.node)
SELECT src, tgt, round((h1 + h2) / 2.0 * 0.35 + CASE WHEN h1 + h2 > 0 THEN (greatest(0, 1 - d1 / 10) + greatest(0, 1 - d2 / 10)) / 2 ELSE 0 END * 0.15 + least(degree / 100.0, 1) * 0.05 + least(weight / 10.0, 1) * 0.15 + rel * 0.35, 6) AS rank,
round(least(degree / 100.0, 1) * 0.7 + least(weight / 10.0, 1) * 0.3, 6) AS timeless FROM f""",
)
def edge_rank(spark: SparkSession, sf: str) -> DataFrame:
    """With two times asked for, and with none."""
    w = facts(spark, sf).groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("weight"), F.collect_set("ts").alias("times"))
    d = graph.edge_degrees(graph.cut_lineage(w))
    none, asked = F.array().cast("array<string>"), F.array(F.lit("1996"), F.lit("2001-Q1"))
    relevance = ranking.lexical_relevance(F.lit("brand#1"), F.col("src"), F.lit(""))
    rank = lambda times: rounded(ranking.edge_rank(times, F.col("times"), F.col("edge_degree"), F.col("weight"), relevance))
    return d.select("src", "tgt", rank(asked).alias("rank"), rank(none).alias("timeless"))


@query(
    "r4_lexical_relevance",
    """SELECT c_custkey, CASE WHEN contains(lower(c_name), 'building') OR contains(lower(c_mktsegment), 'building site') OR contains('building site', lower(c_name)) THEN 1.0 WHEN contains(lower(c_mktsegment), 'building') OR contains(lower(c_mktsegment), 'site') THEN 0.5 ELSE 0.0 END::DOUBLE AS relevance FROM customer""",
)
def lexical_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", ranking.lexical_relevance(F.lit("building site"), F.col("c_name"), F.col("c_mktsegment")).alias("relevance"))


@query(
    "e15_report_packing",
    f"""WITH {TRADE}, b AS (SELECT DISTINCT ts, src, tgt FROM trade), n AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY src, tgt) AS rn FROM b), k AS (SELECT ts, src, tgt, rn FROM n),
l AS (SELECT ts, rn, E'"' || src || E'",\\t"' || tgt || '"' AS line FROM k), m AS (SELECT *, sum(len(regexp_extract_all(line, '[^ \\t\\n\\r]+'))) OVER (PARTITION BY ts ORDER BY rn) AS used FROM l)
SELECT ts, E'id,\\tsource,\\ttarget\\n' || string_agg((rn - 1) || E',\\t' || line, E'\\n' ORDER BY rn) AS packed FROM m WHERE used <= 60 GROUP BY ts""",
)
def report_packing(spark: SparkSession, sf: str) -> DataFrame:
    b = trade(spark, sf).select("ts", "src", "tgt").distinct()
    return reports.pack_rows(b, "ts", ["src", "tgt"], [F.col("src"), F.col("tgt")], 60, "id,\tsource,\ttarget")


@query(
    "e14_naive_context",
    """WITH s AS (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings e, embeddings q WHERE q.vec_id = 0), t AS (SELECT * FROM s WHERE sim >= 0.2 ORDER BY sim DESC, vec_id LIMIT 20),
j AS (SELECT vec_id, n_chars, sum(n_chars) OVER (ORDER BY sim DESC, vec_id ROWS UNBOUNDED PRECEDING) AS total FROM t JOIN documents ON doc_id = vec_id) SELECT vec_id, n_chars FROM j WHERE total <= 30000""",
)
def naive_context(spark: SparkSession, sf: str) -> DataFrame:
    hits = vector.query(table(spark, sf, "embeddings"), _vector0(spark, sf), 20, id_col="vec_id").select("vec_id", "similarity")
    rows = hits.join(table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars"), "vec_id")
    return window.token_budget(rows, "n_chars", [F.desc("similarity"), F.col("vec_id")], 30000).select("vec_id", "n_chars")


@query(
    "st1_daily_window_counts",
    "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def daily_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming aggregate's batch twin."""
    e = table(spark, sf, "events")
    return e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# ---------------------------------------------------------------- lookups and composites of the query modes


@query("f16_described_edges", f"WITH {FACTS} SELECT src, tgt, count(*) AS n FROM facts WHERE description LIKE 'R%' GROUP BY 1, 2")
def described_edges(spark: SparkSession, sf: str) -> DataFrame:
    kept = F.map_filter("description", lambda _, v: v.startswith("R"))
    return graph.edges_with_maps(facts(spark, sf)).select("src", "tgt", F.size(kept).cast("bigint").alias("n")).where("n > 0")


@query("j5_hierarchy_node_lookup", f"""WITH {TH}, g AS (SELECT '"' || ts || '"' AS name, count(*) AS n FROM daily GROUP BY ts) SELECT t.ts, coalesce(g.n, 0) AS n FROM th_nodes t LEFT JOIN g ON replace(g.name, '"', '') = t.ts""")
def hierarchy_node_lookup(spark: SparkSession, sf: str) -> DataFrame:
    quoted = daily(spark, sf).groupBy(F.concat(F.lit('"'), "ts", F.lit('"')).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return tree(spark, sf)[0].select("ts").join(quoted.select(text.sanitize(F.col("name")).alias("ts"), "n"), "ts", "left").select("ts", F.coalesce("n", F.lit(0)).alias("n"))


@query("j8_sub_reports", f"WITH {TH}, r AS (SELECT ts, count(*) AS rating FROM daily GROUP BY ts) SELECT parent, child, rating FROM th_edges JOIN r ON child = ts")
def sub_reports(spark: SparkSession, sf: str) -> DataFrame:
    r = daily(spark, sf).groupBy(F.col("ts").alias("child")).agg(F.count(F.lit(1)).alias("rating"))
    return tree(spark, sf)[1].join(r, "child").select("parent", "child", "rating")


@query("j11_edges_among_top", f"WITH {DEGREES}, top AS (SELECT node, degree FROM degrees ORDER BY degree DESC, node LIMIT 60) SELECT src, tgt, s.degree + t.degree AS score FROM edges JOIN top s ON src = s.node JOIN top t ON tgt = t.node")
def edges_among_top(spark: SparkSession, sf: str) -> DataFrame:
    e = graph.cut_lineage(edges(spark, sf))
    top = window.top_k(graph.degrees(e), [F.desc("degree"), F.col("node")], 60)
    return e.join(top.toDF("src", "ds"), "src").join(top.toDF("tgt", "dt"), "tgt").select("src", "tgt", (F.col("ds") + F.col("dt")).alias("score"))


@query("j12_map_unnest", f"WITH {FACTS} SELECT chunk_id, count(*) AS n, min(ts) AS first FROM facts GROUP BY chunk_id")
def map_unnest(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph.edges_with_maps(facts(spark, sf)).select(F.explode("source_id").alias("ts", "chunk_id"))
    return rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))


@query("j13_ranked_chunks", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id) WHERE quality = 0 QUALIFY rank <= 25")
def ranked_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").where("quality = 0").select("doc_id"), "doc_id")
    best = window.top_k(d, [F.desc("n_chars"), F.col("doc_id")], 25)
    return best.select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).cast("bigint").alias("rank"))


@query(
    "e8_seed_nodes",
    f"""WITH {DEGREES}, h AS (SELECT src, tgt, (length(chunk_id) % 5 + length(tgt) % 3) / 10.0 AS s FROM facts WHERE ts = '1996-Q1'), e AS (SELECT src AS node, s FROM h UNION ALL SELECT tgt, s FROM h)
SELECT node, max(s)::DOUBLE AS similarity, any_value(degree) AS degree FROM e JOIN degrees USING (node) WHERE node LIKE 'Customer%' GROUP BY node ORDER BY similarity DESC, node LIMIT 20""",
)
def seed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    f = graph.cut_lineage(facts(spark, sf))
    hits = f.where("ts = '1996-Q1'").select("src", "tgt", ((F.length("chunk_id") % 5 + F.length("tgt") % 3) / 10.0).alias("similarity"))
    nodes = table(spark, sf, "customer").select(F.col("c_name").alias("entity_name"))
    return retrieval.seed_nodes(hits, nodes, graph.degrees(f.select("src", "tgt").distinct()), 20)


@query(
    "e1_related_communities",
    """WITH r AS (SELECT c_mktsegment AS cluster, round(avg(c_acctbal), 0) AS rating FROM customer GROUP BY 1) SELECT cluster, count(*) AS n, any_value(rating) AS rating FROM customer JOIN r ON cluster = c_mktsegment WHERE c_custkey % 7 = 0 GROUP BY cluster ORDER BY n DESC, rating DESC, cluster LIMIT 3""",
)
def related_communities(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    clusters = c.select(F.col("c_name").alias("node"), F.lit(0).alias("level"), F.col("c_mktsegment").alias("cluster"))
    made = c.groupBy(F.col("c_mktsegment").alias("cluster")).agg(F.round(F.avg("c_acctbal"), 0).alias("rating"))
    return retrieval.related_communities(c.where("c_custkey % 7 = 0").select(F.col("c_name").alias("node")), clusters, made, 2, 3)


@query("e3_temporal_text_units", """SELECT doc_id AS chunk_id, t AS ts, md5('Content from ' || t || ': ' || text) AS content_md5 FROM documents CROSS JOIN (VALUES ('2024'), ('2024-Q2')) q(t)""")
def temporal_text_units(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return retrieval.temporal_text_units(chunks, ["2024", "2024-Q2"]).select("chunk_id", "ts", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(
    "e4_related_edges",
    f"""WITH {DEGREES}, w AS (SELECT src, tgt, count(*) AS weight FROM facts GROUP BY 1, 2) SELECT src, tgt, s.degree + t.degree AS rank, weight FROM w JOIN degrees s ON src = s.node JOIN degrees t ON tgt = t.node WHERE src IN ('Brand#11', 'Brand#12') OR tgt IN ('Customer#000000001')""",
)
def related_edges(spark: SparkSession, sf: str) -> DataFrame:
    f = graph.cut_lineage(facts(spark, sf))
    scores = graph.edge_degrees(f.groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("weight"))).withColumnRenamed("edge_degree", "rank")
    asked = spark.createDataFrame([("Brand#11",), ("Brand#12",), ("Customer#000000001",)], "node string")
    return retrieval.related_edges(asked, f.select("src", "tgt").distinct(), scores).select("src", "tgt", "rank", "weight")


@query(
    "e6_temporal_edges_merged",
    f"""WITH {TRADE}, n AS (SELECT tgt, src, min(seq) AS seq FROM trade GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY seq) - 1 AS pos FROM n), b AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS l, count(*) OVER () AS ls FROM (SELECT DISTINCT src FROM n))
SELECT (pos * ls + l)::INT AS rank, src, src || '>' || tgt AS edge FROM r JOIN b USING (src) WHERE pos < 2""",
)
def temporal_edges_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand's edges in order, merged turn by turn: two turns of all brands."""
    t = trade(spark, sf).groupBy("src", "tgt").agg(F.min("seq").alias("seq"))
    ranked = t.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("seq")))
    lists = t.select("src").distinct().count()
    return window.round_robin(ranked.withColumn("edge", F.concat("src", F.lit(">"), "tgt")), "src", "pos", "edge", lists + 1).select("rank", "src", "edge")


@query(
    "e7_temporal_reports",
    f"""WITH {DAILY}, r AS (SELECT ts, count(DISTINCT src) AS n_nodes, count(*) AS n_edges, count(*) % 5 AS rating FROM daily GROUP BY ts) SELECT ts, rating, n_edges, n_nodes FROM r WHERE ts < '2024-01-20' ORDER BY rating DESC, n_edges + n_nodes DESC, ts LIMIT 6""",
)
def temporal_reports(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf)
    r = d.groupBy("ts").agg(F.countDistinct("src").alias("n_nodes"), F.count(F.lit(1)).alias("n_edges"), (F.count(F.lit(1)) % 5).alias("rating"))
    return retrieval.temporal_reports(d.where("ts < '2024-01-20'").select("ts").distinct(), r, 6).select("ts", "rating", "n_edges", "n_nodes")


@query(
    "e13_report_groups",
    """WITH RECURSIVE p AS (SELECT page_id, length(html) % 50 AS n_edges, length(url) AS n_nodes, page_id % 11 AS rating, length(html) AS tokens FROM pages WHERE page_id % 11 >= 2), o AS (SELECT page_id, tokens, row_number() OVER (ORDER BY n_edges DESC, n_nodes DESC, rating DESC, page_id) AS n FROM p),
g AS (SELECT n, page_id, tokens AS used, 0 AS grp FROM o WHERE n = 1 UNION ALL SELECT o.n, o.page_id, CASE WHEN g.used + o.tokens > 20000 THEN o.tokens ELSE g.used + o.tokens END, CASE WHEN g.used + o.tokens > 20000 THEN g.grp + 1 ELSE g.grp END FROM g JOIN o ON o.n = g.n + 1)
SELECT page_id::VARCHAR AS ts, grp::INT AS "group" FROM g""",
)
def global_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The map side of a global query: reports picked, ordered and grouped for the model."""
    p = table(spark, sf, "pages").select("page_id", F.col("page_id").cast("string").alias("ts"), (F.length("html") % 50).alias("n_edges"), F.length("url").alias("n_nodes"), (F.col("page_id") % 11).alias("rating"), F.length("html").cast("bigint").alias("tokens"), F.lit(0).alias("level"))
    picked = reports.select_reports(p, 2, 2, None)
    return reports.report_groups(picked, [F.desc("n_edges"), F.desc("n_nodes"), F.desc("rating"), F.col("page_id")], 20000).select("ts", "group")


@query("g18_safe_ids", "SELECT page_id, regexp_replace(lower(url), '[^a-z0-9_]+', '_', 'g') AS id FROM pages")
def safe_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.safe_id(F.col("url")).alias("id"))


@query("g20_subgraph_entities", f"WITH {TH}, b AS (SELECT DISTINCT src FROM daily WHERE substr(ts, 1, 7) = '2024-01') SELECT src AS entity FROM b")
def subgraph_entities(spark: SparkSession, sf: str) -> DataFrame:
    _, e = tree(spark, sf)
    return retrieval.within_times(daily(spark, sf).select("src", "ts"), spark.createDataFrame([("2024-01",)], "ts string"), e).select(F.col("src").alias("entity")).distinct()


@query("n10_year_quarter", """SELECT event_id, year(ts)::INT AS y, quarter(ts)::INT AS q FROM events""")
def year_quarter(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("in "), F.year("ts"), F.lit(" Q"), F.quarter("ts"), F.lit(" already"))
    return table(spark, sf, "events").select("event_id", timeexpr.extract_year(raw).alias("y"), timeexpr.extract_quarter(raw)["quarter"].alias("q"))


@query("n13_levels", f"WITH {TH} SELECT ts, CASE level WHEN 0 THEN 'year' WHEN 1 THEN 'quarter' WHEN 2 THEN 'month' ELSE 'date' END AS level, level::INT AS number FROM th_nodes")
def levels(spark: SparkSession, sf: str) -> DataFrame:
    n = tree(spark, sf)[0].select("ts", timeexpr.time_level(F.col("ts")).alias("level"))
    return n.withColumn("number", timeexpr.level_number(F.col("level")))


@query("n19_month_numbers", "SELECT o_orderkey, month(o_orderdate)::INT AS m FROM orders")
def month_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", timeexpr.month_number(F.date_format("o_orderdate", "MMMM")).alias("m"))


@query("n24_granularity", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'quarter' ELSE 'date' END AS granularity FROM events")
def granularity(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 3
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit('("granularity"<|>'), F.when(k == 0, "YEAR").when(k == 1, "Quarter").otherwise("date"), F.lit("<|>x)<|COMPLETE|>")).alias("r"))
    return extraction.granularity(extraction.records(e, "event_id", "r"), "event_id")


@query("x10_summarise", """SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) >= 300 THEN 'long' ELSE md5(text) END AS d FROM documents""")
def summarise(spark: SparkSession, sf: str) -> DataFrame:
    rows = extraction.summarise(table(spark, sf, "documents").select("doc_id", F.col("text").alias("d")), "d", 300, F.lit("long"))
    return rows.select("doc_id", F.when(F.col("d") == "long", F.col("d")).otherwise(F.md5(F.col("d").cast("binary"))).alias("d"))


@query("x12_bounds", "SELECT event_id FROM events WHERE value / 100 BETWEEN 0 AND 1 AND event_id % 5 BETWEEN 1 AND 3")
def bounds(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", (F.col("value") / 100).alias("weight"), (F.col("event_id") % 5).alias("order"))
    return extraction.within_bounds(e).select("event_id")


@query("u1_union_dedup", "SELECT user_id, event_type FROM events WHERE event_id % 2 = 0 UNION SELECT user_id, event_type FROM events WHERE event_id % 3 = 0")
def union_dedup(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.where("event_id % 2 = 0").select("user_id", "event_type").unionByName(e.where("event_id % 3 = 0").select("user_id", "event_type")).distinct()


@query("u4_u5_sets", "WITH s AS (SELECT source, lang, doc_id % 3 AS k FROM documents), a AS (SELECT DISTINCT source, lang FROM s WHERE k = 0), b AS (SELECT DISTINCT source, lang FROM s WHERE k = 1) SELECT a.source, count(b.lang) AS common, count(b.lang) = count(*) AS subset FROM a LEFT JOIN b ON a.source = b.source AND a.lang = b.lang GROUP BY a.source")
def sets(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda k: F.collect_set(F.when(F.col("doc_id") % 3 == k, F.col("lang")))
    s = table(spark, sf, "documents").groupBy("source").agg(pick(0).alias("a"), pick(1).alias("b")).where(F.size("a") > 0)
    return s.select("source", F.size(F.array_intersect("a", "b")).cast("bigint").alias("common"), (F.size(F.array_except("a", "b")) == 0).alias("subset"))


# ---------------------------------------------------------------- merging with what is stored, evidence, further stores


@query(
    "j2_node_merge",
    """WITH o AS (SELECT user_id, event_type, event_id FROM events WHERE event_id % 2 = 0), n AS (SELECT user_id, event_type, event_id FROM events WHERE event_id % 2 = 1),
ov AS (SELECT user_id, event_type, count(*) AS c, min(event_id) AS f FROM o GROUP BY 1, 2), ow AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, f) AS r FROM ov) WHERE r = 1),
nv AS (SELECT user_id, event_type, count(*) AS c, min(event_id) AS f FROM n GROUP BY 1, 2), v AS (SELECT user_id, event_type, sum(c) AS c, min(f) AS f FROM (SELECT * FROM nv UNION ALL SELECT user_id, event_type, 1, NULL FROM ow WHERE user_id IN (SELECT user_id FROM n)) GROUP BY 1, 2),
w AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, f NULLS LAST) AS r FROM v) WHERE r = 1),
m AS (SELECT user_id, event_type AS d, (event_id % 5)::VARCHAR AS s FROM events)
SELECT 'USER ' || m.user_id AS entity_name, coalesce(w.event_type, ow.event_type) AS entity_type, string_agg(DISTINCT d, '<SEP>' ORDER BY d) AS description, string_agg(DISTINCT s, '<SEP>' ORDER BY s) AS source_id
FROM m LEFT JOIN w USING (user_id) LEFT JOIN ow USING (user_id) GROUP BY m.user_id, 2""",
)
def node_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two inserts: the second's mentions are merged with the nodes that the first one stored."""
    e = table(spark, sf, "events").select(F.concat(F.lit("USER "), F.col("user_id").cast("string")).alias("entity_name"), F.col("event_type").alias("entity_type"), F.col("event_type").alias("description"), (F.col("event_id") % 5).cast("string").alias("source_id"), F.col("event_id").alias("seq"))
    c = catalog(spark)
    c.upsert("nodes", graph.merge_nodes(e.where("seq % 2 = 0")), ["entity_name"])
    c.upsert("nodes", graph.merge_nodes(e.where("seq % 2 = 1"), c.read("nodes")), ["entity_name"])
    return c.read("nodes").select("entity_name", "entity_type", "description", "source_id")


@query(
    "k7_two_inserts_of_edges",
    f"""WITH {TRADE} SELECT src, tgt, ts, coalesce(arg_max(description, seq) FILTER (seq % 2 = 1), arg_max(description, seq) FILTER (seq % 2 = 0)) AS description FROM trade GROUP BY src, tgt, ts""",
)
def two_inserts_of_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of a second insert replace the stored ones of their edge and time; all others stay."""
    t, c = trade(spark, sf), catalog(spark)
    for part in (0, 1):
        c.upsert("facts", graph.merge_temporal_facts(t.where(F.col("seq") % 2 == part)).drop("seq"), ["src", "tgt", "ts"])
    return c.read("facts").select("src", "tgt", "ts", "description")


@query("x9_time_links", f"WITH {TRADE} SELECT ts, src AS entity FROM trade UNION SELECT ts, tgt FROM trade")
def time_links(spark: SparkSession, sf: str) -> DataFrame:
    return graph.time_links(trade(spark, sf))


@query(
    "e2_t11_text_units",
    f"""WITH {EDGES}, ent AS (SELECT c_name AS node, c_custkey AS rank FROM customer), m AS (SELECT src AS node, chunk_id FROM facts UNION SELECT tgt, chunk_id FROM facts), s AS (SELECT src AS node, tgt AS other FROM edges UNION SELECT tgt, src FROM edges),
f AS (SELECT chunk_id, min(rank) AS rank FROM m JOIN ent USING (node) GROUP BY 1), n AS (SELECT f.*, node FROM f JOIN ent USING (rank)),
c AS (SELECT n.chunk_id, n.rank, count(DISTINCT s.other) AS relation_counts FROM n LEFT JOIN m o ON o.chunk_id = n.chunk_id LEFT JOIN s ON s.node = n.node AND s.other = o.node GROUP BY 1, 2),
b AS (SELECT *, sum(10 + length(chunk_id) % 3) OVER (ORDER BY rank, relation_counts DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS used FROM c)
SELECT chunk_id, rank, relation_counts FROM b WHERE used <= 4000""",
)
def related_text_units(spark: SparkSession, sf: str) -> DataFrame:
    f = graph.cut_lineage(facts(spark, sf).select("src", "tgt", "chunk_id"))
    mentions = f.select(F.explode(F.array("src", "tgt")).alias("node"), "chunk_id").distinct()
    chunks = f.select("chunk_id", (10 + F.length("chunk_id") % 3).alias("tokens")).distinct()
    ent = table(spark, sf, "customer").select(F.col("c_name").alias("node"), F.col("c_custkey").alias("rank"))
    return retrieval.text_units(ent, mentions, f.select("src", "tgt").distinct(), chunks, 4000).select("chunk_id", "rank", "relation_counts")


@query(
    "e5_temporal_edges",
    f"""WITH {FACTS}, e AS (SELECT src, tgt, count(*) AS w, string_agg(ts || ': ' || description, '; ' ORDER BY ts) AS description FROM facts GROUP BY 1, 2 HAVING bool_or(ts IN ('1996-Q1', '1997'))),
b AS (SELECT src AS node, row_number() OVER (ORDER BY src) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT src FROM e)),
l AS (SELECT e.*, b.rank AS l, n, row_number() OVER (PARTITION BY src ORDER BY w DESC, tgt) - 1 AS pos FROM e JOIN b ON node = src)
SELECT (pos * n + l)::INT AS rank, src AS node, src, tgt, description FROM l WHERE pos * n + l < 20""",
)
def temporal_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of all brands at two times, merged by turns; brands stand left of customers."""
    e = graph.cut_lineage(graph.edges_with_maps(facts(spark, sf)))
    brands = retrieval.edges_at(e, ["1996-Q1", "1997"]).select("src").distinct()
    ranked = window.enumerate_rows(brands, [F.col("src")], "rank").select(F.col("src").alias("node"), F.col("rank").cast("int").alias("rank"))
    return retrieval.temporal_edges(ranked, e, ["1996-Q1", "1997"], 20)


@query("e10_same_years", f"WITH {TH} SELECT ts FROM th_nodes WHERE substr(ts, 1, 4) = '2024'")
def same_years(spark: SparkSession, sf: str) -> DataFrame:
    """The wider times of the supplemental search."""
    return retrieval.same_years(spark.createDataFrame([("2024-Q3",)], "ts string"), tree(spark, sf)[0])


@query(
    "e11_split_budget",
    """WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS n FROM documents), a AS (SELECT doc_id, 'entity' AS kind, sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM d WHERE doc_id % 2 = 0),
b AS (SELECT doc_id, 'relation' AS kind, sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM d WHERE doc_id % 2 = 1) SELECT doc_id, kind FROM a WHERE used <= 12000 UNION ALL SELECT doc_id, kind FROM b WHERE used <= 48000""",
)
def split_budget(spark: SparkSession, sf: str) -> DataFrame:
    """A fifth of a budget for entities, the rest for relations."""
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("rank"), F.col("text").alias("description"))
    a, b = retrieval.split_budget(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), 60_000)
    return a.select("doc_id", F.lit("entity").alias("kind")).union(b.select("doc_id", F.lit("relation").alias("kind")))


@query(
    "t8_sub_reports",
    """WITH r AS (SELECT page_id % 20 AS parent, page_id, length(html) % 50 AS occurrence, page_id || E',\\t"r' || page_id % 7 || ' of ' || page_id % 3 || '"' AS line FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY occurrence DESC, page_id::VARCHAR) AS rn FROM r),
u AS (SELECT *, sum(len(regexp_extract_all(line, '[^ \\t\\n\\r]+'))) OVER (PARTITION BY parent ORDER BY rn) AS used FROM n)
SELECT parent, E'id,\\tcluster,\\treport\\n' || string_agg((rn - 1) || E',\\t' || line, E'\\n' ORDER BY rn) AS packed FROM u WHERE used <= 12 GROUP BY parent""",
)
def sub_reports_packed(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    text_of = F.concat(F.lit("r"), (F.col("page_id") % 7).cast("string"), F.lit(" of "), (F.col("page_id") % 3).cast("string"))
    subs = p.select((F.col("page_id") % 20).alias("parent"), F.col("page_id").cast("string").alias("cluster"), (F.length("html") % 50).alias("occurrence"), text_of.alias("report_string"))
    return reports.pack_sub_reports(subs, 12)


@query(
    "t12_related_edges_budget",
    f"""WITH {DEGREES}, w AS (SELECT src, tgt, count(*) AS weight, string_agg(ts || ': ' || description, '; ' ORDER BY ts) AS description FROM facts GROUP BY 1, 2), r AS (SELECT src, tgt, s.degree + t.degree AS rank, weight, len(regexp_extract_all(w.description, '[^ ]+')) AS n FROM w JOIN degrees s ON src = s.node JOIN degrees t ON tgt = t.node),
u AS (SELECT *, sum(n) OVER (ORDER BY rank DESC, weight DESC, src, tgt ROWS UNBOUNDED PRECEDING) AS used FROM r) SELECT src, tgt, rank, weight FROM u WHERE used <= 3000""",
)
def related_edges_budget(spark: SparkSession, sf: str) -> DataFrame:
    e = graph.cut_lineage(graph.edges_with_maps(facts(spark, sf)).select("src", "tgt", F.size("description").cast("bigint").alias("weight"), text.describe_map(F.col("description")).alias("description")))
    scores = graph.edge_degrees(e.select("src", "tgt", "weight")).withColumnRenamed("edge_degree", "rank")
    every = graph.symmetric(e).select("node").distinct()
    return retrieval.related_edges(every, e.select("src", "tgt", "description"), scores, 3000).select("src", "tgt", "rank", "weight")


@query(
    "p6_cluster_attributes",
    """SELECT c_name AS entity_name, CASE WHEN c_custkey % 3 = 0 THEN '[]' ELSE '[{"level":0,"cluster":"' || c_mktsegment || '"},{"level":1,"cluster":"' || c_mktsegment || '/' || c_nationkey || '"}]' END AS clusters FROM customer""",
)
def cluster_attributes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    own = c.where("c_custkey % 3 <> 0")
    clusters = own.select(F.col("c_name").alias("node"), F.lit(0).alias("level"), F.col("c_mktsegment").alias("cluster")).union(own.select("c_name", F.lit(1), F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string"))))
    return graph.with_clusters(c.select(F.col("c_name").alias("entity_name")), clusters)


@query("l13_claims", """SELECT event_id, 'USER ' || user_id AS subject, upper(event_type) AS object, strftime(ts, '%Y-%m-%d') AS start, year(ts) || '-Q' || quarter(ts) AS "end" FROM events WHERE event_id % 4 <> 0""")
def claim_records(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of eight fields; every fourth record lacks one."""
    e = table(spark, sf, "events")
    day, quarter = F.date_format("ts", "yyyy-MM-dd"), F.concat(F.year("ts"), F.lit("-q"), F.quarter("ts"))
    parts = [F.concat(F.lit("(user "), F.col("user_id").cast("string")), F.col("event_type"), F.lit("acted"), F.lit("TRUE"), day, quarter, F.lit("it did")]
    body = F.when(F.col("event_id") % 4 == 0, F.concat_ws("<|>", *parts)).otherwise(F.concat_ws("<|>", *parts, F.lit("quote")))
    rows = e.select("event_id", F.concat(body, F.lit(")<|COMPLETE|>")).alias("r"))
    return extraction.claims(extraction.records(rows, "event_id", "r"), "event_id").select("event_id", "subject", "object", "start", "end")


@query(
    "x6_mixed_levels",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '2023-01-01,' || strftime(ts, '%Y-%m-%d') WHEN 1 THEN '2023-Q1,' || year(ts) || '-Q' || quarter(ts) ELSE strftime(ts, '%Y-%m') || ',2025-12' END AS times FROM events""",
)
def mixed_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges whose ends have different levels."""
    k = F.col("event_id") % 3
    pair = F.when(k == 0, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("<|>2023"))).when(k == 1, F.concat(F.lit("2023<|>"), F.year("ts"), F.lit("-Q"), F.quarter("ts"))).otherwise(F.concat(F.lit("2025<|>"), F.date_format("ts", "yyyy-MM")))
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit('("entity"<|>between<|>'), pair, F.lit("<|>date)<|COMPLETE|>")).alias("r"))
    c = extraction.time_constraints(extraction.records(e, "event_id", "r"), "event_id")
    return c.select("event_id", F.array_join("timestamps", ",").alias("times"))


@query(
    "s9_stored_index",
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS sim FROM embeddings, q) SELECT vec_id, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""",
)
def stored_index(spark: SparkSession, sf: str) -> DataFrame:
    """A stored index, written by two upserts that overlap, asked with as many probes as it has cells: exact."""
    c = vector.CellIndex(catalog(spark), cells=16, probes=16)
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    c.upsert(rows.where("id % 3 <> 0"))
    c.upsert(rows.where("id % 2 = 0 or id % 3 = 0"))
    best = c.query(_vector0(spark, sf), 10)
    return best.select(F.col("id").alias("vec_id"), F.row_number().over(Window.orderBy(F.desc("similarity"), "id")).cast("bigint").alias("rank"))


@query(
    "r4_semantic_relevance",
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(greatest(0, list_cosine_similarity(embedding::DOUBLE[], v)), 6) AS relevance FROM embeddings, q""",
)
def semantic_relevance(spark: SparkSession, sf: str) -> DataFrame:
    relevance = ranking.semantic_relevance(vector.literal(_vector0(spark, sf)), F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", rounded(relevance).alias("relevance"))
