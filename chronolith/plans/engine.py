"""The engine: insert documents into a temporal graph, ask it in local, global or naive mode."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranking
from ..functions.text import hash_id, token_count
from ..functions.timeexpr import time_path
from ..operators import chunking, extraction, graph, reports, retrieval, vector
from ..operators.window import token_budget
from ..sources.catalog import Catalog
from .costs import Tracker
from .providers import Providers, QueryParam

SEP = graph.PACKED
CALLS = "prompt double, completion double, embedding double, hit boolean"


def call_model(rows: DataFrame, fn: Callable, column: str, out: str, retries: int = 1, backoff: float = 0.0, batched: bool = False) -> DataFrame:
    """A provider over a text column, with retries: text by text, or an Arrow batch at once where it takes lists."""

    def attempts(value):  # noqa: ANN001, ANN202
        for attempt in range(retries):
            try:
                return fn(value)
            except Exception:
                if attempt == retries - 1:
                    raise
                time.sleep(backoff * 2**attempt)

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            values = attempts(pdf[column].tolist()) if batched else [attempts(text) for text in pdf[column]]
            yield pdf.assign(**{out: pd.Series(values, dtype=object, index=pdf.index)})

    kind = "array<double>" if out == "embedding" else "string"
    return rows.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{out}` {kind}")


class TemporalGraph:
    """A graph in a folder. ``insert`` adds what is new; ``query`` answers.

    ``chunker(docs) -> (full_doc_id, chunk_order_index, tokens, content)`` of ``docs(doc_id, title, doc)`` replaces the token
    windows; ``extractor(chunks) -> (chunk_id, response)`` replaces the calls of the extraction provider.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        providers: Providers | None = None,
        chunk_size: int = 1200,
        overlap: int = 100,
        chunker: Callable[[DataFrame], DataFrame] | None = None,
        extractor: Callable[[DataFrame], DataFrame] | None = None,
        summary_tokens: int | None = 500,
        community_reports: bool = False,
        cluster_size: int = 10,
    ):
        self.spark, self.catalog, self.providers = spark, Catalog(spark, root), providers or Providers()
        self.size, self.overlap, self.chunker, self.extractor = chunk_size, overlap, chunker, extractor
        self.summary_tokens, self.community, self.cluster_size = summary_tokens, community_reports, cluster_size
        self.tracker, self._pool = Tracker(), None

    # -------------------------------------------------------------- building

    def insert(self, docs: DataFrame) -> int:
        """Documents ``(title, doc)`` that the store doesn't have yet, by content; the number of new chunks.

        New mentions are merged with the nodes stored under their names; an end of a relation that is neither new nor
        stored gets a placeholder. Only what changed is embedded, and only times whose descendants changed are reported on
        anew. Documents and chunks are registered last, so that a failed run can be done again.
        """
        c, p = self.catalog, self.providers
        stripped = F.regexp_replace("doc", "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "")
        new = docs.select("title", stripped.alias("doc")).withColumn("doc_id", hash_id(F.col("doc"), "doc-")).dropDuplicates(["doc_id"])
        new = graph.cut_lineage(c.new_keys("full_docs", new, "doc_id"))
        if new.isEmpty():
            return 0
        windows = self.chunker(new) if self.chunker else chunking.token_windows(new, self.size, self.overlap, "doc_id", "doc", F.col("title"))
        chunks = graph.cut_lineage(c.new_keys("text_chunks", chunking.keyed_chunks(windows), "chunk_id"))
        count = chunks.count()
        if not count:
            return 0
        asked = chunks.select("chunk_id", "content")
        raw = graph.cut_lineage(self.extractor(chunks) if self.extractor else call_model(asked, p.records, "content", "response"))
        nodes, facts = self._merge(raw)
        self._embed(nodes, facts, chunks)
        self._hierarchy(facts)
        if self.community:
            self.report_communities()
        c.upsert("full_docs", new.select("doc_id", "title", "doc"), ["doc_id"])
        c.upsert("text_chunks", chunks, ["chunk_id"])
        calls = raw.join(asked.withColumnRenamed("content", "asked"), "chunk_id").select(token_count(F.col("asked")).cast("double").alias("prompt"), token_count(F.col("response")).cast("double").alias("completion"), F.lit(0.0).alias("embedding"), F.lit(False).alias("hit"))
        self.tracker.add(calls)
        self.tracker.done(chunks=count, entities=nodes.count(), relations=facts.count())
        return count

    def _merge(self, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
        """New and changed nodes and facts of responses ``(chunk_id, response)``, both stored."""
        c, p = self.catalog, self.providers
        parsed = extraction.records(raw, "chunk_id", "response")
        ents = extraction.entities(parsed, "chunk_id").withColumnsRenamed({"chunk_id": "source_id"}).withColumn("seq", F.xxhash64("source_id", "pos"))
        rels = extraction.relations(parsed, "chunk_id").withColumn("seq", F.struct("chunk_id", "pos"))
        facts = graph.cut_lineage(graph.merge_temporal_facts(rels.select("src", "tgt", "ts", "description", "chunk_id", "seq")).drop("seq"))
        stored = c.read("nodes", "entity_name string, entity_type string, description string, source_id string")
        nodes = graph.merge_nodes(ents.select("entity_name", "entity_type", "description", "source_id", "seq"), stored)
        if self.summary_tokens:
            long = token_count(F.col("description")) >= self.summary_tokens
            nodes = graph.cut_lineage(nodes)
            short = call_model(nodes.where(long).select("entity_name", "description"), p.summarise, "description", "summary", p.retries).select("entity_name", "summary")
            nodes = extraction.summarise(nodes.join(short, "entity_name", "left"), "description", self.summary_tokens, F.nullif(F.col("summary"), F.lit(""))).drop("summary")
        known = nodes.select("entity_name").union(stored.select("entity_name"))
        nodes = graph.cut_lineage(nodes.unionByName(graph.missing_endpoints(known, facts)))
        c.upsert("nodes", nodes, ["entity_name"])
        c.upsert("edge_facts", facts, ["src", "tgt", "ts"])
        c.upsert("time_links", graph.time_links(facts), ["ts", "entity"])
        return nodes, facts

    def _embed(self, nodes: DataFrame, facts: DataFrame, chunks: DataFrame) -> None:
        """Vectors of what changed."""
        c, p = self.catalog, self.providers
        vectors = lambda rows: call_model(rows, p.vectors, "content", "embedding", p.retries, p.backoff, batched=True)
        c.upsert("entity_vectors", vectors(extraction.entity_payload(nodes)), ["id"])
        c.upsert("relation_vectors", vectors(extraction.relation_payload(facts)), ["id"])
        c.upsert("chunk_vectors", vectors(chunks.select("chunk_id", "content")).drop("content"), ["chunk_id"])

    def _hierarchy(self, new: DataFrame) -> None:
        """The hierarchy, its sizes, and reports for every time at or above a new fact's."""
        c = self.catalog
        nodes, edges = graph.hierarchy(new)
        touched = graph.cut_lineage(nodes.select("ts"))
        old = c.read("th_nodes", "ts string, level int, entity_type string, instantiation boolean")
        kept = nodes.unionByName(old).groupBy("ts", "level", "entity_type").agg(F.max("instantiation").alias("instantiation"))
        c.write("th_nodes", kept)
        c.upsert("th_edges", edges, ["parent", "child"])
        nodes, edges, facts = c.read("th_nodes"), c.read("th_edges"), c.read("edge_facts")
        up = graph.cut_lineage(graph.reach(facts).join(touched.withColumnRenamed("ts", "ancestor"), "ancestor", "left_semi"))
        below = graph.cut_lineage(facts.join(graph.small(up.select("ts").distinct()), "ts", "left_semi"))
        sizes = graph.cut_lineage(graph.roll_up(below).join(touched, "ts", "left_semi"))
        c.upsert("hierarchy", sizes, ["ts"])
        rows = below.join(graph.small(up), "ts").withColumnRenamed("ancestor", "key")
        packed = reports.pack_rows(rows, "key", ["src", "tgt", "ts", "description"], [F.col("ts"), F.col("src"), F.col("tgt")], 4000, "id,\tsource,\ttarget,\ttime,\tdescription")
        contexts = packed.select(F.col("key").alias("ts"), F.concat(F.lit("Time "), "key", F.lit("\n"), "packed").alias("packed")).join(nodes.select("ts", "level"), "ts").select("ts", "level", "packed")
        known = c.read("reports").select("ts", "report_string") if c.version("reports") else None
        made = reports.generate_reports(graph.cut_lineage(contexts), edges, self.providers.report, self.providers.retries, known)
        held = made.join(sizes.select("ts", F.col("n_edges"), F.col("n_nodes")), "ts")
        c.upsert("reports", held.select("ts", "level", "report_string", "report_json", F.col("report_json.rating").alias("rating"), "n_edges", "n_nodes"), ["ts"])

    def report_communities(self) -> DataFrame:
        """Communities of the relation graph with a report each, upper ones after their parts; also written into the nodes."""
        c = self.catalog
        facts = c.read("edge_facts")
        edges = graph.cut_lineage(facts.select("src", "tgt").distinct())
        clusters = graph.cut_lineage(graph.communities(edges, self.cluster_size))
        held = facts.select(F.explode(F.array("src", "tgt")).alias("entity"), "chunk_id").distinct()
        table = graph.cut_lineage(graph.community_table(clusters, edges, held))
        parts = table.where("level = 1").select("cluster", "nodes"), table.where("level = 0").select("cluster", "nodes")
        below = graph.sub_communities(*parts).select(F.col("parent"), F.col("cluster").alias("child"))
        contexts = reports.community_contexts(table, graph.degrees(edges))
        made = reports.generate_reports(graph.cut_lineage(contexts), graph.cut_lineage(below), self.providers.community_report, self.providers.retries)
        out = made.withColumnRenamed("ts", "cluster").join(table.select("cluster", "level", "occurrence"), ["cluster", "level"])
        c.write("community_reports", out.select("cluster", "level", "occurrence", "report_string", "report_json", F.col("report_json.rating").alias("rating")))
        c.write("nodes", graph.with_clusters(c.read("nodes").drop("clusters"), clusters).select("entity_name", "entity_type", "description", "source_id"))
        c.write("clusters", clusters)
        return c.read("community_reports")

    def hierarchy_members(self, ts: str) -> DataFrame:
        """The facts of a time and all its descendants."""
        up = F.array_contains(time_path(F.col("ts")).getField("ts"), ts)
        return self.catalog.read("edge_facts").where(up)

    # -------------------------------------------------------------- asking

    def query(self, question: str, param: QueryParam | None = None) -> str:
        return self.query_with_details(question, param)[0]

    def query_later(self, question: str, param: QueryParam | None = None) -> Future[str]:
        """The answer as a future; jobs of several questions share the session."""
        self._pool = self._pool or ThreadPoolExecutor(4)
        return self._pool.submit(self.query, question, param)

    def insert_later(self, docs: DataFrame) -> Future[int]:
        self._pool = self._pool or ThreadPoolExecutor(4)
        return self._pool.submit(self.insert, docs)

    def query_with_details(self, question: str, param: QueryParam | None = None) -> tuple[str, dict[str, int]]:
        """The answer, and how many pieces of each kind of evidence it rests on.

        Where a model or a table fails, the answer is the fail response and the details are zeros.
        """
        param = param or QueryParam()
        modes = {"local": (self._local, self.providers.respond), "global": (self._global, self.providers.reduce), "naive": (self._naive, self.providers.naive)}
        if param.mode not in modes:
            raise ValueError(f"unknown mode {param.mode!r}")
        build, respond = modes[param.mode]
        details = dict.fromkeys(("entity", "relation", "community", "text_units"), 0)
        try:
            context, found = build(question, param)
            answer = None if not context else context if param.only_context else respond(f"{question}\n{context}")
            details |= found
        except Exception:  # noqa: BLE001  the contract of a query: it answers
            answer = None
        self.tracker.asked(answer is not None)
        if answer is None:
            return self.providers.fail_response, dict.fromkeys([*details, "total_evidence"], 0)
        return answer, details | {"total_evidence": sum(details.values())}

    def _render(self, rows: list) -> str:
        """The chunks of a context, a budget's worth."""
        return "\n--New Chunk--\n".join(f"[{r['title']}]\n{r['content']}" for r in rows)

    def _titled(self, chunks: DataFrame) -> DataFrame:
        titles = self.catalog.read("full_docs").select(F.col("doc_id").alias("full_doc_id"), F.coalesce("title", "doc_id").alias("title"))
        return chunks.join(titles, "full_doc_id", "left").withColumn("title", F.coalesce("title", F.lit("Unknown Document")))

    def _asked(self, question: str, param: QueryParam) -> DataFrame:
        """``(ts)``: the times that a question asks for, at the level that it, or the parameter, wants."""
        c, p = self.catalog, self.providers
        one = lambda text: self.spark.createDataFrame([("q", text)], "q string, response string")
        # a handful of rows behind long expressions: cut off, so that what follows isn't planned with them
        constraints = graph.cut_lineage(extraction.time_constraints(extraction.records(one(p.times(question)), "q", "response"), "q"))
        nodes, edges = c.read("th_nodes"), c.read("th_edges")
        times = retrieval.retrieve_times(constraints, nodes, edges).select("ts").distinct()
        level = param.granularity
        if level is None:
            two = extraction.split_granularity(one(p.granularity(question)), "q", "response").first()
            level = two.granularity if two else None
        if level and level.lower() in ("year", "quarter", "month", "week", "date"):
            times = retrieval.align_times(times, edges, level.lower())
        return graph.cut_lineage(times.join(nodes.select("ts"), "ts", "left_semi"))

    def _local(self, question: str, param: QueryParam) -> tuple[str, dict[str, int]]:
        c, p = self.catalog, self.providers
        times = self._asked(question, param)
        some = None if times.isEmpty() else times
        edges = c.read("th_edges")
        hits = graph.cut_lineage(vector.query(c.read("relation_vectors"), p.embed(question), 3 * param.top_k))
        scored = retrieval.evidence(c.read("edge_facts"), hits, some, edges if some is not None else None, param.top_k)
        best = [F.desc("score"), F.col("chunk_id")]
        rows = token_budget(scored.join(self._titled(c.read("text_chunks")), "chunk_id"), "tokens", best, param.local_tokens).orderBy(*best).collect()
        found = {"entity": 0, "relation": 0, "community": 0, "text_units": len(rows)}
        if len(rows) < param.least_evidence:
            more, found = self._supplement(question, param, times, hits, {r["chunk_id"] for r in rows}, sum(r["tokens"] for r in rows))
            rows, found = rows + more, found | {"text_units": len(rows) + len(more)}
        return self._render(rows), found

    def _ranked(self, names: DataFrame, question: str, times: list[str]) -> DataFrame:
        """Nodes of ``names(node)`` with their rank for the question: ``(node, rank, description)``, the best first from 0."""
        c = self.catalog
        own = c.read("time_links").groupBy(F.col("entity").alias("node")).agg(F.collect_set("ts").alias("times"))
        d = graph.degrees(c.read("edge_facts").select("src", "tgt").distinct())
        rows = names.distinct().join(c.read("nodes").withColumnRenamed("entity_name", "node"), "node").join(d, "node", "left").join(own, "node", "left")
        asked, none = F.array(*map(F.lit, times)).cast("array<string>"), F.array().cast("array<string>")
        relevance = ranking.lexical_relevance(F.lit(question), F.col("node"), F.col("description"))
        score = ranking.entity_rank(asked, F.coalesce("times", none), F.coalesce("degree", F.lit(0)), relevance)
        listed = rows.withColumn("score", score).orderBy(F.desc("score"), "node").limit(1_000).collect()  # a few searches' hits
        return self.spark.createDataFrame([(r.node, i, r.description) for i, r in enumerate(listed)], "node string, rank int, description string")

    def _supplement(self, question: str, param: QueryParam, times: DataFrame, hits: DataFrame, given: set[str], used: int) -> tuple[list, dict[str, int]]:
        """Further evidence where the first search found little.

        Entities come from the other kind of seeds; with fewer than two, from the years of the question's times; with fewer
        than two even then, from a wider search. Their relations at the times, the times' reports and their chunks follow.
        """
        c, p = self.catalog, self.providers
        asked = [r.ts for r in times.orderBy("ts").collect()]
        nodes, v = c.read("nodes"), p.embed(question)
        degrees = graph.degrees(c.read("edge_facts").select("src", "tgt").distinct())
        if param.seeds == "entities":
            names = retrieval.seed_nodes(hits, nodes, degrees, param.top_k).select("node")
        else:
            names = vector.query(c.read("entity_vectors"), v, param.top_k).select(F.col("entity_name").alias("node"))
        names = graph.cut_lineage(names.distinct())
        if asked and names.limit(2).count() < 2:
            broad = retrieval.same_years(times, c.read("th_nodes"))
            inside = c.read("time_links").join(broad, "ts", "left_semi").select(F.col("entity").alias("entity_name")).distinct().withColumn("inside", F.lit(True))
            vectors = c.read("entity_vectors").join(inside, "entity_name", "left")
            near = vector.temporal_query(vectors, v, F.col("inside"), param.top_k).select(F.col("entity_name").alias("node"))
            names = graph.cut_lineage(names.union(near).distinct())
        if names.limit(2).count() < 2:
            wide = vector.query(c.read("entity_vectors"), v, 2 * param.top_k, -1.0).select(F.col("entity_name").alias("node"))
            names = graph.cut_lineage(names.union(wide).distinct())
        entities = self._ranked(names, question, asked)
        edges = graph.edges_with_maps(c.read("edge_facts"))
        if asked:
            relations = retrieval.temporal_edges(entities.select("node", "rank"), edges, asked, param.top_k)
        else:
            scores = graph.edge_degrees(edges.select("src", "tgt", F.size("description").alias("weight"))).withColumnRenamed("edge_degree", "rank")
            relations = retrieval.related_edges(entities.select("node"), edges.select("src", "tgt", F.array_join(F.map_values("description"), "; ").alias("description")), scores, param.context_tokens).limit(param.top_k)
        entities_kept, relations_kept = retrieval.split_budget(entities, relations.select("rank", "description"), param.context_tokens)
        communities = retrieval.temporal_reports(times, c.read("reports"), param.top_k).count() if asked else 0
        mentions = c.read("edge_facts").select(F.explode(F.array("src", "tgt")).alias("node"), "chunk_id").distinct()
        room = max(0, param.local_tokens - used)
        chunks = self._titled(c.read("text_chunks").where(~F.col("chunk_id").isin(*given)) if given else c.read("text_chunks"))
        if asked:
            units = retrieval.temporal_text(entities.select("node"), mentions, chunks, asked, room).orderBy("chunk_order_index", "chunk_id", "ts")
        else:
            pairs = c.read("edge_facts").select("src", "tgt").distinct()
            units = retrieval.text_units(entities.select("node", "rank"), mentions, pairs, chunks, room).orderBy("rank", F.desc("relation_counts"), "chunk_id")
        return units.collect(), {"entity": entities_kept.count(), "relation": relations_kept.count(), "community": communities}

    def _global(self, question: str, param: QueryParam) -> tuple[str, dict[str, int]]:
        p = self.providers
        picked = reports.select_reports(self.catalog.read("reports"), param.level, param.min_rating, param.max_reports)
        rows = graph.cut_lineage(picked.select("ts", "n_edges", "n_nodes", "rating", "report_string", token_count(F.col("report_string")).alias("tokens")))
        groups = reports.report_groups(rows, [F.desc("n_edges"), F.desc("n_nodes"), F.desc("rating"), F.col("ts")], param.global_tokens)
        prompts = groups.join(rows.select("ts", "report_string"), "ts").groupBy("group").agg(F.array_join(F.array_sort(F.collect_list("report_string")), "\n").alias("prompt"))
        found = reports.points(call_model(prompts, p.points, "prompt", "response", p.retries))
        found = found.withColumn("tokens", token_count(F.col("description")))
        kept = token_budget(found, "tokens", [F.desc("score"), F.col("analyst"), F.col("description")], param.global_tokens)
        listed = kept.orderBy(F.desc("score"), "analyst", "description").collect()
        return "\n".join(f"----Analyst {r['analyst']}----\nImportance Score: {r['score']}\n{r['description']}" for r in listed), {"community": rows.count()}

    def _naive(self, question: str, param: QueryParam) -> tuple[str, dict[str, int]]:
        hits = vector.query(self.catalog.read("chunk_vectors"), self.providers.embed(question), param.top_k, id_col="chunk_id")
        rows = hits.select("chunk_id", "similarity").join(self._titled(self.catalog.read("text_chunks")), "chunk_id")
        best = [F.desc("similarity"), F.col("chunk_id")]
        listed = token_budget(rows, "tokens", best, param.naive_tokens).orderBy(*best).collect()
        return self._render(listed), {"text_units": len(listed)}
