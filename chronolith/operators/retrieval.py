"""Retrieval: time constraints to times, alignment of levels, evidence by personalized PageRank, chunk scores, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import describe_map, token_count
from ..functions.timeexpr import extract_year, level_number, parent_time, time_level, time_start
from .graph import closure, personalized_pagerank, relation_counts, undirected
from .window import round_robin, token_budget, top_k


def retrieve_times(constraints: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(ts, via)`` of hierarchy nodes that time constraints ``(logic, timestamps, level)`` ask for.

    ``at``: the node itself, and its children (``via`` child); before, after and between: nodes of the same level by
    their first days, the ends of a range included. Several constraints add up.
    """
    wanted = constraints.select("logic", "level", F.get("timestamps", F.lit(0)).alias("t1"), F.coalesce(F.get("timestamps", F.lit(1)), F.get("timestamps", F.lit(0))).alias("t2"))
    start = time_start(F.col("ts"))
    at = wanted.where("logic = 'at'").join(nodes.select("ts"), F.col("t1") == F.col("ts")).select("ts", F.lit("self").alias("via"))
    children = at.join(edges, F.col("ts") == F.col("parent")).select(F.col("child").alias("ts"), F.lit("child").alias("via"))
    # constraints come from one question: a handful of rows
    near = nodes.select("ts", F.col("level").alias("node_level")).join(F.broadcast(wanted.where("logic <> 'at'")), F.col("node_level") == F.col("level"))
    a, b = time_start(F.col("t1")), time_start(F.col("t2"))
    ok = F.when(F.col("logic") == "before", start < a).when(F.col("logic") == "after", start > a).otherwise(start.between(a, b))
    return at.union(children).union(near.where(ok).select("ts", F.col("logic").alias("via"))).distinct()


def align_times(times: DataFrame, edges: DataFrame, level: str) -> DataFrame:
    """Times brought to a level: finer wanted - descendants of that level and the times themselves; coarser wanted - their
    ancestors and themselves; same - as they are."""
    want = {"year": 0, "quarter": 1, "month": 2, "week": 2, "date": 3}[level]
    own = times.select("ts").distinct().withColumn("l", level_number(time_level(F.col("ts"))))
    finer = own.where(F.col("l") < want).join(closure(edges), F.col("ts") == F.col("ancestor")).where(time_level(F.col("descendant")) == level).select(F.col("descendant").alias("ts"))
    coarser = own.where(F.col("l") > want).select(parent_time(F.col("ts"), level).alias("ts"))
    return own.select("ts").union(finer).union(coarser).distinct()


def within_times(facts: DataFrame, times: DataFrame, edges: DataFrame) -> DataFrame:
    """Facts whose time is one of ``times(ts)`` or a descendant of one."""
    reach = times.select("ts").union(closure(edges).join(times.withColumnRenamed("ts", "ancestor"), "ancestor").select(F.col("descendant").alias("ts"))).distinct()
    return facts.join(reach, "ts", "left_semi")


def chunk_scores(facts: DataFrame, node_scores: DataFrame, similarities: DataFrame | None = None) -> DataFrame:
    """``(chunk_id, score)``: the sum of its edges' scores times the product of 1 + similarity.

    An edge ``(src, tgt, chunk_id)`` scores if both ends do; ``similarities(src, tgt, similarity)`` may lack edges,
    which then count 0. The ends' join replaces trying all pairs of nodes.
    """
    scored = facts.join(node_scores.toDF("src", "ss"), "src").join(node_scores.toDF("tgt", "st"), "tgt")
    if similarities is not None:
        scored = scored.join(undirected(similarities).groupBy("src", "tgt").agg(F.max("similarity").alias("similarity")), ["src", "tgt"], "left")
    else:
        scored = scored.withColumn("similarity", F.lit(0.0))
    gamma = F.coalesce("similarity", F.lit(0.0))
    return scored.groupBy("chunk_id").agg((F.sum(F.col("ss") + F.col("st")) * F.exp(F.sum(F.ln(F.greatest(1 + gamma, F.lit(1e-12)))))).alias("score"))


def evidence(facts: DataFrame, hits: DataFrame, times: DataFrame | None, hierarchy_edges: DataFrame | None, k: int = 20, max_iter: int = 100) -> DataFrame:
    """``(chunk_id, score)`` of the best k chunks for relation hits ``(src, tgt, ts, similarity)``.

    The best 3k hits, those in the times asked for, give the seeds; the 2k nodes of highest personalized PageRank are
    kept; facts between them, in those times, score their chunks.
    """
    facts = undirected(facts)
    best = top_k(hits, [F.desc("similarity"), F.col("src"), F.col("tgt"), F.col("ts")], 3 * k)
    if times is not None:
        best = within_times(best, times, hierarchy_edges)
        facts = within_times(facts, times, hierarchy_edges)
    seeds = best.select(F.col("src").alias("node")).union(best.select("tgt")).distinct()
    ranks = personalized_pagerank(facts.select("src", "tgt").distinct(), seeds, max_iter=max_iter)
    nodes = top_k(ranks, [F.desc("score"), F.col("node")], 2 * k)
    return top_k(chunk_scores(facts, nodes, best), [F.desc("score"), F.col("chunk_id")], k)


def split_budget(entities: DataFrame, relations: DataFrame, budget: int, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Entities and relations, both ``(rank, description, ..)``, within their shares of a token budget: a fifth and the rest."""
    cut = lambda rows, part: token_budget(rows.withColumn("tokens", token_count(F.coalesce("description", F.lit("UNKNOWN")))), "tokens", [F.col("rank")], int(budget * part)).drop("tokens")
    return cut(entities, share), cut(relations, 1 - share)


def text_units(entities: DataFrame, mentions: DataFrame, edges: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """Chunks that speak of ranked entities ``(node, rank)``, within a token budget: ``(chunk_id, rank, relation_counts, ..)``.

    ``mentions(node, chunk_id)``. A chunk stands once, with the first entity it belongs to; of one entity's chunks, those go
    first that speak of more of its neighbours.
    """
    own = mentions.join(entities, "node")
    first = own.groupBy("chunk_id").agg(F.min_by(F.struct("node", "rank"), F.struct("rank", "node")).alias("e")).select("chunk_id", F.col("e.node").alias("entity"), F.col("e.rank").alias("rank"))
    named = mentions.select(F.col("node").alias("entity"), "chunk_id")
    counts = relation_counts(entities.select(F.col("node").alias("entity")), edges, named).select("entity", "chunk_id", "relation_counts")
    rows = first.join(counts, ["entity", "chunk_id"]).join(chunks, "chunk_id")
    return token_budget(rows, "tokens", [F.col("rank"), F.desc("relation_counts"), F.col("chunk_id")], budget)


def temporal_text(entities: DataFrame, mentions: DataFrame, chunks: DataFrame, times: list[str], budget: int) -> DataFrame:
    """Chunks of entities, each once for every time of the question and led by it, in the order of their documents, within a
    token budget."""
    own = chunks.join(mentions.join(entities, "node", "left_semi").select("chunk_id").distinct(), "chunk_id")
    rows = temporal_text_units(own, times).withColumn("tokens", token_count(F.col("content")))
    return token_budget(rows, "tokens", [F.col("chunk_order_index"), F.col("chunk_id"), F.col("ts")], budget)


def edges_at(edges: DataFrame, times: list[str]) -> DataFrame:
    """Edges with facts at any of the times: a key of their map (``description``), or a time that its texts mention."""
    keyed = F.exists(F.map_keys("description"), lambda k: k.isin(*times))
    spoken = F.exists(F.map_values("description"), lambda v: F.exists(F.array(*map(F.lit, times)), lambda t: F.lower(v).contains(F.lower(t))))
    return edges.where(keyed | F.coalesce(spoken, F.lit(False)))


def temporal_edges(entities: DataFrame, edges: DataFrame, times: list[str], k: int) -> DataFrame:
    """``(rank, node, src, tgt, description)``: edges of ranked entities ``(node, rank)`` at the times, merged by turns.

    ``edges(src, tgt, description map[, weight, order])``. Each entity gives its best k, by weight, then order; texts are
    ``time: text`` joined by ``; ``.
    """
    weight = F.col("weight") if "weight" in edges.columns else F.size("description").cast("double")
    order = F.col("order") if "order" in edges.columns else F.lit(1)
    found = edges_at(edges, times).select("src", "tgt", "description", weight.alias("w"), order.alias("o"))
    ends = found.withColumn("node", F.explode(F.array_distinct(F.array("src", "tgt")))).join(entities, "node")
    w = Window.partitionBy("node").orderBy(F.desc("w"), F.desc("o"), "src", "tgt")
    lists = ends.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select("rank", "node", "pos", F.concat_ws("\x1f", "src", "tgt").alias("edge"))
    merged = round_robin(lists.select(F.struct("rank", "node").alias("list"), "pos", "edge").select(F.concat_ws("\x1f", F.lpad(F.col("list.rank").cast("string"), 9, "0"), "list.node").alias("list"), "pos", "edge"), "list", "pos", "edge", k)
    merged = merged.select("rank", F.substring_index("list", "\x1f", -1).alias("node"), F.split("edge", "\x1f")[0].alias("src"), F.split("edge", "\x1f")[1].alias("tgt")).where(F.col("rank") < k)
    return merged.join(found, ["src", "tgt"]).select("rank", "node", "src", "tgt", describe_map(F.col("description")).alias("description"))


def same_years(times: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(ts)``: all times of the hierarchy in the years of the question's times."""
    year = extract_year(F.col("ts")).alias("year")
    return nodes.select("ts", year).join(times.select(year).distinct(), "year", "left_semi").select("ts")


def cluster_counts(entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(cluster, n)``: to how many of the entities ``(node)`` each cluster belongs."""
    return clusters.join(entities, "node").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def related_communities(entities: DataFrame, clusters: DataFrame, reports: DataFrame, level: int, k: int) -> DataFrame:
    """``(cluster, n, rating)``: reports of the clusters that most of the entities belong to, best rated first of equals.

    Clusters without a report are passed over.
    """
    counted = cluster_counts(entities, clusters.where(F.col("level") <= level))
    return top_k(counted.join(reports, "cluster"), [F.desc("n"), F.desc("rating"), F.col("cluster")], k)


def related_edges(entities: DataFrame, edges: DataFrame, edge_scores: DataFrame, budget: int | None = None) -> DataFrame:
    """Edges at any of the entities ``(node)``, each once, with ``(rank, weight)`` of ``edge_scores(src, tgt, ..)``.

    With a budget, the best by rank and weight whose ``description`` texts fit its tokens.
    """
    at_src = edges.join(entities.withColumnRenamed("node", "src"), "src", "left_semi")
    at_tgt = edges.join(entities.withColumnRenamed("node", "tgt"), "tgt", "left_semi")
    found = at_src.unionByName(at_tgt).distinct().join(edge_scores, ["src", "tgt"])
    if budget is None:
        return found
    best = [F.desc("rank"), F.desc("weight"), F.col("src"), F.col("tgt")]
    return token_budget(found.withColumn("tokens", token_count(F.coalesce("description", F.lit("")))), "tokens", best, budget).drop("tokens")


def temporal_text_units(chunks: DataFrame, times: list[str], id_col: str = "chunk_id") -> DataFrame:
    """Every chunk once for each of the question's times, its content led by the time."""
    each = F.explode(F.array(*map(F.lit, times)))
    return chunks.dropDuplicates([id_col]).withColumn("ts", each).withColumn("content", F.concat(F.lit("Content from "), "ts", F.lit(": "), "content"))


def temporal_reports(times: DataFrame, reports: DataFrame, k: int) -> DataFrame:
    """Reports of the times, by rating, then by size."""
    return top_k(reports.join(times, "ts"), [F.desc("rating"), F.desc(F.col("n_edges") + F.col("n_nodes")), F.col("ts")], k)


def seed_nodes(hits: DataFrame, nodes: DataFrame, degrees: DataFrame, k: int) -> DataFrame:
    """``(node, similarity, degree)``: ends of relation hits that are nodes, by their best hit."""
    ends = hits.select(F.col("src").alias("node"), "similarity").union(hits.select("tgt", "similarity"))
    best = ends.groupBy("node").agg(F.max("similarity").alias("similarity"))
    known = best.join(nodes.select(F.col("entity_name").alias("node")), "node", "left_semi").join(degrees, "node")
    return top_k(known, [F.desc("similarity"), F.col("node")], k)
