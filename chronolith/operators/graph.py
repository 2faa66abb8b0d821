"""The temporal graph: merging nodes and edges, degrees, hierarchy, closure, roll-up, communities, PageRank.

Tables: nodes ``(entity_name, entity_type, description, source_id)``; edge facts in long form ``(src, tgt, ts,
description, chunk_id, seq)``; edges with maps keyed by time. Edges are undirected: keys are (least, greatest).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeexpr import level_number, time_path
from .window import last_known

PACKED = "<SEP>"


#: Rows of a counted table that may be broadcast.
BROADCAST_ROWS = 1_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; where none is set, local mode gets one of our own, a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="chronolith-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def small(df: DataFrame) -> DataFrame:
    """A table of a cut lineage, marked for broadcast if its rows are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def by_distinct(df: DataFrame, column: str, out: str, fn: Callable[[Column], Column]) -> DataFrame:
    """``df`` with ``out``, a costly expression of ``column`` that is worked out once for each different value."""
    values = cut_lineage(df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(out, fn(F.col(column))))
    return df.join(small(values), column, "left")


def undirected(edges: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Edges with their ends in order."""
    return edges.withColumns({src: F.least(src, tgt), tgt: F.greatest(src, tgt)})


def symmetric(edges: DataFrame) -> DataFrame:
    """``(node, other)`` both ways; a loop stands once in each way."""
    return edges.select(F.col("src").alias("node"), F.col("tgt").alias("other")).unionAll(edges.select("tgt", "src"))


# ---------------------------------------------------------------- merging


def merge_nodes(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Nodes of ``(entity_name, entity_type, description, source_id, seq)``, merged with ``stored`` nodes of those names.

    The type with most votes wins, of equals the one seen first; different descriptions and sources are sorted and
    packed. A stored node has one vote for its type, after the new ones, a placeholder (``UNKNOWN``) none. Two aggregates,
    both partial before their shuffle on the name.
    """
    parts = lambda c: F.filter(F.split(c, f"\\Q{PACKED}\\E"), lambda x: x != "")
    votes = rows.select("entity_name", "entity_type", F.lit(1).alias("vote"), "seq", F.array("description").alias("d"), F.array("source_id").alias("s"))
    if stored is not None:
        known = stored.join(rows.select("entity_name").distinct(), "entity_name", "left_semi")
        vote = F.when(F.col("entity_type") == "UNKNOWN", 0).otherwise(1)
        votes = votes.unionByName(known.select("entity_name", "entity_type", vote.alias("vote"), F.lit(None).cast(dict(rows.dtypes)["seq"]).alias("seq"), parts("description").alias("d"), parts("source_id").alias("s")))
    votes = votes.groupBy("entity_name", "entity_type").agg(F.sum("vote").alias("n"), F.min("seq").alias("first"), F.collect_set("d").alias("d"), F.collect_set("s").alias("s"))
    packed = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list(c))))), PACKED)
    return votes.groupBy("entity_name").agg(F.max_by("entity_type", F.struct("n", -F.col("first"))).alias("entity_type"), packed("d").alias("description"), packed("s").alias("source_id"))


def merge_static_edges(rows: DataFrame) -> DataFrame:
    """``weight`` summed, ``order`` least (1 if missing), different descriptions and sources sorted and packed."""
    packed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), PACKED)
    return undirected(rows).groupBy("src", "tgt").agg(
        F.sum("weight").alias("weight"), F.min(F.coalesce("order", F.lit(1))).alias("order"), packed("description").alias("description"), packed("source_id").alias("source_id")
    )


def merge_temporal_facts(rows: DataFrame) -> DataFrame:
    """One fact per (src, tgt, ts): of each column what was written last; nulls write nothing."""
    return last_known(undirected(rows), ["src", "tgt", "ts"], "seq")


def edges_with_maps(facts: DataFrame) -> DataFrame:
    """Edges ``(src, tgt, description map, source_id map)`` of merged facts; a fact without a time has the key ''."""
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("ts", F.lit("")).alias("ts"), c))))
    return facts.groupBy("src", "tgt").agg(entries("description").alias("description"), entries("chunk_id").alias("source_id"))


def missing_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of type UNKNOWN for ends of edges that ``nodes`` doesn't have."""
    ends = symmetric(edges).select(F.col("node").alias("entity_name")).distinct()
    new = ends.join(nodes.select("entity_name"), "entity_name", "left_anti")
    return new.select("entity_name", F.lit("UNKNOWN").alias("entity_type"), F.lit("").alias("description"), F.lit("").alias("source_id"))


def time_links(facts: DataFrame) -> DataFrame:
    """``(ts, entity)``: which entities a time's facts speak of."""
    return facts.select("ts", F.explode(F.array("src", "tgt")).alias("entity")).distinct()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of a key that both have, new values where they are not null."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    columns = [F.coalesce(*([F.col(f"n.{c}")] if c in new.columns else []), *([F.col(f"o.{c}")] if c in old.columns else [])).alias(c) for c in dict.fromkeys([*old.columns, *new.columns])]
    return o.join(n, on, "full_outer").select(*columns)


# ---------------------------------------------------------------- degrees and neighbourhoods


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)``; a loop counts twice."""
    return symmetric(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    """Edges with the sum of their ends' degrees."""
    d = degrees(edges)
    return edges.join(d.toDF("src", "ds"), "src").join(d.toDF("tgt", "dt"), "tgt").withColumn("edge_degree", F.col("ds") + F.col("dt")).drop("ds", "dt")


def in_out_degrees(edges: DataFrame) -> DataFrame:
    rows = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("tgt", F.lit(0), F.lit(1)))
    return rows.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def incident(edges: DataFrame, node: Column) -> DataFrame:
    """Edges at a node."""
    return edges.where((F.col("src") == node) | (F.col("tgt") == node))


def two_hops(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``(ts, entity, src, tgt)``: edges at the neighbours of each start ``(ts)``."""
    s = symmetric(edges)
    first = starts.join(s.toDF("ts", "entity"), "ts").distinct()
    return first.join(s.toDF("entity", "other"), "entity").select("ts", F.least("entity", "other").alias("src"), F.greatest("entity", "other").alias("tgt")).distinct()


def relation_counts(entities: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(entity, chunk_id, relation_counts)``: how many one-hop neighbours of an entity its chunk also speaks of.

    ``chunks(entity, chunk_id)`` are the sources of all nodes.
    """
    own = entities.join(chunks, "entity").select("entity", "chunk_id")
    near = symmetric(edges).toDF("entity", "other").distinct()
    # from the entities of each chunk, which a text bounds; a hub's neighbours and all their chunks have no bound
    shared = own.join(chunks.select(F.col("entity").alias("other"), "chunk_id"), "chunk_id").join(near, ["entity", "other"], "left_semi")
    shared = shared.groupBy("entity", "chunk_id").agg(F.countDistinct("other").alias("relation_counts"))
    return own.join(shared, ["entity", "chunk_id"], "left").withColumn("relation_counts", F.coalesce("relation_counts", F.lit(0)))


# ---------------------------------------------------------------- hierarchy


def hierarchy(times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the time hierarchy of ``(ts)`` rows.

    nodes ``(ts, level, entity_type, instantiation)`` with all ancestors, those that no row names not instantiated;
    edges ``(parent, child, description)`` such as ``YEAR->QUARTER``. Both follow from the different times alone, which
    are read once.
    """
    path = cut_lineage(times.select("ts").distinct().select("ts", time_path(F.col("ts")).alias("path")).where("path is not null"))
    nodes = path.select(F.explode("path").alias("n"), (F.col("n.ts") == F.col("ts")).alias("own")).groupBy("n.ts", "n.kind").agg(F.max("own").alias("instantiation"))
    nodes = nodes.select("ts", level_number(F.col("kind")).alias("level"), F.upper("kind").alias("entity_type"), "instantiation")
    pairs = path.select(F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("p"), F.slice("path", 2, F.size("path")).alias("c"))).alias("e")).where("e.p is not null and e.c is not null")
    edges = pairs.select(F.col("e.p.ts").alias("parent"), F.col("e.c.ts").alias("child"), F.concat(F.upper(F.col("e.p.kind")), F.lit("->"), F.upper(F.col("e.c.kind"))).alias("description")).distinct()
    return nodes, edges


def closure(edges: DataFrame) -> DataFrame:
    """``(ancestor, descendant)`` of hierarchy edges, which are at most three deep: four levels."""
    one = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct()
    step = one.toDF("descendant", "further")
    two = one.join(step, "descendant").select("ancestor", F.col("further").alias("descendant"))
    three = two.join(step, "descendant").select("ancestor", F.col("further").alias("descendant"))
    return one.union(two).union(three).distinct()


def reach(times: DataFrame) -> DataFrame:
    """``(ts, ancestor)`` of different times ``(ts)``: each time and all that hold it."""
    return cut_lineage(times.select("ts").distinct().select("ts", F.explode(time_path(F.col("ts")).getField("ts")).alias("ancestor")))


def members(facts: DataFrame, up: DataFrame | None = None) -> dict[str, DataFrame]:
    """What each time and its descendants hold, in long form: ``node (ancestor, node)``, ``edge (ancestor, ts, src, tgt)``,
    ``chunk (ancestor, chunk_id)``. ``facts(src, tgt, ts, chunk_id)``; no time's members are ever gathered in one row.
    """
    up = small(up if up is not None else reach(facts))
    ends = facts.select("ts", F.explode(F.array("src", "tgt")).alias("node")).distinct()
    return {
        "node": ends.join(up, "ts").select("ancestor", "node").distinct(),
        "edge": facts.select("ts", "src", "tgt").distinct().join(up, "ts").select("ancestor", "ts", "src", "tgt"),
        "chunk": facts.select("ts", "chunk_id").distinct().join(up, "ts").select("ancestor", "chunk_id").distinct(),
    }


def roll_up(facts: DataFrame) -> DataFrame:
    """``(ts, level, n_nodes, n_edges, n_chunks, sub_communities, all_sub_communities, occurrence)`` of every time.

    Sizes are those of the unions over a time and all its descendants; the two arrays hold its children and descendants,
    a calendar's worth at most. The hierarchy is worked out once, of the different times.
    """
    nodes, edges = (cut_lineage(x) for x in hierarchy(facts))
    held = members(facts, reach(facts))
    counts = None
    for kind, rows in held.items():
        own = rows.groupBy("ancestor").agg(F.count(F.lit(1)).alias(f"n_{kind}s"))
        counts = own if counts is None else counts.join(own, "ancestor", "full_outer")
    children = edges.groupBy(F.col("parent").alias("ancestor")).agg(F.array_sort(F.collect_set("child")).alias("sub_communities"))
    every = closure(edges).groupBy("ancestor").agg(F.array_sort(F.collect_set("descendant")).alias("all_sub_communities"))
    out = nodes.select(F.col("ts").alias("ancestor"), "level").join(counts, "ancestor", "left").join(children, "ancestor", "left").join(every, "ancestor", "left")
    none = F.array().cast("array<string>")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(F.col("ancestor").alias("ts"), "level", number("n_nodes"), number("n_edges"), number("n_chunks"), F.coalesce("sub_communities", none).alias("sub_communities"), F.coalesce("all_sub_communities", none).alias("all_sub_communities"), F.lit(1.0).alias("occurrence"))


# ---------------------------------------------------------------- communities


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``(node, component)``: the least node reachable, by contraction of links until none is left."""
    links, labels = cut_lineage(edges.select("src", "tgt").where("src <> tgt").distinct()), None
    for _ in range(rounds):
        if links.isEmpty():
            break
        both = links.union(links.select("tgt", "src"))
        least = cut_lineage(both.groupBy("src").agg(F.min("tgt").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component")))
        for _ in range(3):  # chains in ascending order: pointers jump over eight at a time
            least = least.join(least.toDF("component", "next"), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        least = cut_lineage(least)
        links = cut_lineage(links.join(least.toDF("src", "a"), "src").join(least.toDF("tgt", "b"), "tgt").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("tgt")).distinct())
        if labels is None:
            labels = least
        else:
            labels = cut_lineage(labels.join(least.toDF("component", "next"), "component", "left").select("node", F.coalesce("next", "component").alias("component")))
    alone = symmetric(edges).select("node").distinct()
    return alone.withColumn("component", F.col("node")) if labels is None else alone.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the component with most nodes, of equals the one of the least node; names upper-cased, in order."""
    named = edges.select(F.upper("src").alias("src"), F.upper("tgt").alias("tgt"))
    parts = cut_lineage(components(named))
    best = parts.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    inside = parts.join(F.broadcast(best), "component", "left_semi").select(F.col("node").alias("src"))
    return undirected(named.join(inside, "src", "left_semi")).distinct().orderBy("src", "tgt")


def communities(edges: DataFrame, max_size: int = 10, rounds: int = 5) -> DataFrame:
    """``(node, level, cluster)``: label propagation in synchronous rounds, then clusters over ``max_size`` once more.

    A node takes the label most frequent among its neighbours and itself (without its own, two sides of a graph would
    swap labels for ever), of equals the least; as many rounds at each of two levels. Level 1 propagates along the links
    inside the large clusters of level 0; what is over ``max_size`` even then is cut into slices by name. The same input
    gives the same clusters.
    """
    s = cut_lineage(symmetric(edges).where("node <> other").distinct())
    nodes = s.select("node").distinct()

    def propagate(nodes: DataFrame, links: DataFrame) -> DataFrame:
        labels = cut_lineage(nodes.select("node", F.col("node").alias("label")))
        for _ in range(rounds):
            heard = links.join(labels.toDF("other", "label"), "other").select("node", "label").union(labels)
            votes = heard.groupBy("node", "label").count()
            labels = cut_lineage(votes.groupBy("node").agg(F.min(F.struct(-F.col("count"), "label")).alias("b")).select("node", F.col("b.label").alias("label")))
        return labels

    top = propagate(nodes, s)
    large = top.groupBy("label").count().where(F.col("count") > max_size).select("label")
    inside = cut_lineage(top.join(large, "label", "left_semi").select("node", F.col("label").alias("l1")))
    inner = s.join(inside, "node").join(inside.toDF("other", "l2"), "other").where("l1 = l2").select("node", "other")
    parts = inside.join(propagate(inside.select("node"), cut_lineage(inner)), "node")
    cluster = Window.partitionBy("l1", "label")
    part = F.floor((F.row_number().over(cluster.orderBy("node")) - 1) / max_size).cast("string")
    parts = parts.withColumn("part", F.when(F.count(F.lit(1)).over(cluster) > max_size, part))
    second = parts.select("node", F.lit(1).alias("level"), F.concat_ws("/", "l1", "label", "part").alias("cluster"))
    return top.select("node", F.lit(0).alias("level"), F.col("label").alias("cluster")).union(second)


def community_table(clusters: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(cluster, level, nodes, edges, chunk_ids, occurrence)``; occurrence is relative to the largest chunk set."""
    nodes = clusters.groupBy("level", "cluster").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    inside = edges.join(clusters.toDF("src", "level", "cluster"), "src").join(clusters.toDF("tgt", "level", "c2"), ["tgt", "level"]).where("cluster = c2")
    pairs = inside.groupBy("level", "cluster").agg(F.array_sort(F.collect_set(F.struct("src", "tgt"))).alias("edges"))
    found = clusters.join(chunks.withColumnRenamed("entity", "node"), "node").groupBy("level", "cluster").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    out = nodes.join(pairs, ["level", "cluster"], "left").join(found, ["level", "cluster"], "left")
    out = out.withColumns({"edges": F.coalesce("edges", F.array().cast("array<struct<src:string,tgt:string>>")), "chunk_ids": F.coalesce("chunk_ids", F.array().cast("array<string>"))})
    most = out.agg(F.max(F.size("chunk_ids")).alias("most"))
    return out.crossJoin(F.broadcast(most)).withColumn("occurrence", F.coalesce(F.size("chunk_ids") / F.nullif("most", F.lit(0)), F.lit(0.0))).drop("most")


def with_clusters(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Nodes ``(entity_name, ..)`` with ``clusters``: JSON of their ``[{level, cluster}]`` by level, empty for none."""
    own = clusters.groupBy(F.col("node").alias("entity_name")).agg(F.to_json(F.array_sort(F.collect_set(F.struct("level", "cluster")))).alias("clusters"))
    return nodes.join(own, "entity_name", "left").withColumn("clusters", F.coalesce("clusters", F.lit("[]")))


def sub_communities(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """``(cluster, parent)``: clusters of the level below whose nodes all belong to one above. By shared members, not by
    trying all pairs."""
    l, u = lower.select(F.col("cluster"), F.size("nodes").alias("n"), F.explode("nodes").alias("node")), upper.select(F.col("cluster").alias("parent"), F.explode("nodes").alias("node"))
    return l.join(u, "node").groupBy("cluster", "parent", "n").count().where("count = n").select("cluster", "parent")


# ---------------------------------------------------------------- PageRank


class Rounds:
    """Tables of an iteration in the shared folder: the one before the last is removed when a new one is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.made = spark, f"{checkpoint_dir(spark)}/chronolith-rounds-{uuid.uuid4().hex[:12]}", 0

    def save(self, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.root}/{self.made}")
        if self.made > 1:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self.made - 2}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.made += 1
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.made - 1}")


#: Arcs of a graph that is small enough to be ranked in memory.
LOCAL_ARCS = 1_000_000


def _ranks_in_memory(arcs: DataFrame, ranks: DataFrame, alpha: float, max_iter: int, tol: float) -> DataFrame:
    """The same iteration over a graph whose size was counted."""
    a, r = arcs.toPandas(), ranks.toPandas().sort_values("node", ignore_index=True)
    at = pd.Index(r["node"])
    src, tgt, p = at.get_indexer(a["src"]), at.get_indexer(a["tgt"]), a["p"].to_numpy(float)
    x, seed, gives = (r[c].to_numpy() for c in ("score", "seed", "gives"))
    for _ in range(max_iter):
        new = alpha * (np.bincount(tgt, x[src] * p, len(x)) + x[~gives.astype(bool)].sum() * seed) + (1 - alpha) * seed
        moved, x = np.abs(new - x).sum(), new
        if moved < len(x) * tol:
            return ranks.sparkSession.createDataFrame(pd.DataFrame({"node": r["node"], "score": x}), "node string, score double")
    return ranks.select("node", "score").where(F.lit(False))


def personalized_pagerank(edges: DataFrame, seeds: DataFrame | None = None, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6, local_arcs: int = LOCAL_ARCS) -> DataFrame:
    """``(node, score)`` of an undirected graph ``(src, tgt[, weight])``, by power iteration.

    ``seeds(node[, weight])``: those in the graph share the restart mass by weight; none in it, or none at all: all
    nodes alike. A node without weight to give away gives to the seeds. Stops at an L1 change below nodes * ``tol``; if
    ``max_iter`` rounds don't reach it, the result is empty. A loop counts once. A round is one job: it writes its ranks, and
    the change is observed meanwhile. Graphs of ``local_arcs`` arcs and nodes at most are ranked in memory, to the same end.
    """
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    one = undirected(edges.select("src", "tgt", weight.cast("double").alias("w"))).groupBy("src", "tgt").agg(F.sum("w").alias("w"))
    if "weight" not in edges.columns:
        one = one.withColumn("w", F.lit(1.0))
    both = one.unionAll(one.where("src <> tgt").select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "w"))
    total = both.groupBy("src").agg(F.sum("w").alias("t"))
    arcs = cut_lineage(both.join(total, "src").where("t > 0").select("src", "tgt", (F.col("w") / F.col("t")).alias("p")))
    nodes = symmetric(one).select("node").distinct()
    if seeds is not None:
        seeds = seeds.withColumn("weight", F.col("weight") if "weight" in seeds.columns else F.lit(1.0))
        known = seeds.join(nodes, "node", "left_semi").groupBy("node").agg(F.sum("weight").alias("weight"))
        mass = known.agg(F.sum("weight")).first()[0]
    if seeds is None or not mass:
        n = nodes.count()
        ranks = nodes.withColumn("seed", F.lit(1.0 / max(n, 1)))
    else:
        ranks = nodes.join(known, "node", "left").select("node", (F.coalesce("weight", F.lit(0.0)) / mass).alias("seed"))
        n = ranks.count()
    gives = arcs.select(F.col("src").alias("node")).distinct().withColumn("gives", F.lit(True))
    ranks = cut_lineage(ranks.join(gives, "node", "left").select("node", "seed", F.coalesce("gives", F.lit(False)).alias("gives"), F.lit(1.0 / max(n, 1)).alias("score")))
    if n and arcs.limit(local_arcs + 1).count() <= local_arcs and n <= local_arcs:
        return _ranks_in_memory(arcs, ranks.select("node", "seed", "gives", "score"), alpha, max_iter, tol)
    tables = Rounds(edges.sparkSession)
    for _ in range(max_iter):
        got = arcs.join(ranks.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("tgt").alias("node")).agg(F.sum(F.col("score") * F.col("p")).alias("got"))
        lost = ranks.where(~F.col("gives")).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        new = ranks.join(got, "node", "left").crossJoin(F.broadcast(lost))
        score = alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("seed")) + (1 - alpha) * F.col("seed")
        new = new.select("node", "seed", "gives", score.alias("score"), F.abs(score - F.col("score")).alias("moved"))
        moved = Observation()
        ranks = tables.save(new.observe(moved, F.sum("moved").alias("moved"))).drop("moved")
        if (moved.get["moved"] or 0.0) < n * tol:
            return ranks.select("node", "score")
    return ranks.select("node", "score").where(F.lit(False))


def stable_order(edges: DataFrame) -> DataFrame:
    """Edges by ``"src -> tgt"``."""
    return undirected(edges).orderBy(F.concat_ws(" -> ", "src", "tgt"))


def recall(gold: Column, found: Column) -> Column:
    """Share of the gold set that was found; 0 for an empty one."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(gold, found)) / F.size(F.array_distinct(gold))).otherwise(0.0)
