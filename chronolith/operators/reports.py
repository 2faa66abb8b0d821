"""Reports over times and communities: packing under budgets, leaf-to-root generation, map-reduce over ratings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import csv_row, token_count

REPORT = "struct<title:string,summary:string,rating:double,rating_explanation:string,findings:array<struct<summary:string,explanation:string>>>"


def pack_rows(rows: DataFrame, key: str, columns: list[str], order: list[Column], budget: int, header: str) -> DataFrame:
    """``(key, packed)``: a CSV block per key of the rows, in order, that fit the token budget."""
    line = csv_row(*[F.col(c) for c in columns])
    w = Window.partitionBy(key).orderBy(*order)
    # a line has a token at least, so no more than ``budget`` lines of a key can fit: tasks pass on no more of theirs
    numbered = rows.withColumn("__line", line).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= budget)
    used = F.sum(token_count(F.col("__line"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = numbered.withColumn("__used", used).where(F.col("__used") <= budget)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("__n", "__line"))), lambda x: F.concat((x["__n"] - 1).cast("string"), F.lit(",\t"), x["__line"]))
    return kept.groupBy(key).agg(F.concat(F.lit(header + "\n"), F.array_join(lines, "\n")).alias("packed"))


def repair_report(parsed: Column) -> Column:
    """A report struct with every required field: missing ones get a default, ratings are held in 0 to 10."""
    return F.struct(
        F.coalesce(parsed["title"], F.lit("Untitled")).alias("title"),
        F.coalesce(parsed["summary"], F.lit("")).alias("summary"),
        F.least(F.greatest(F.coalesce(parsed["rating"], F.lit(0.0)), F.lit(0.0)), F.lit(10.0)).alias("rating"),
        F.coalesce(parsed["rating_explanation"], F.lit("")).alias("rating_explanation"),
        F.coalesce(parsed["findings"], F.array().cast("array<struct<summary:string,explanation:string>>")).alias("findings"),
    )


def generate_reports(contexts: DataFrame, edges: DataFrame, model: Callable[[str], str], retries: int = 3, known: DataFrame | None = None) -> DataFrame:
    """``(ts, level, report_string, report_json)`` of ``contexts(ts, level, packed)``, leaves before roots.

    Levels are a handful, so the driver goes through them; a level's calls are Arrow batches on the executors. A node's
    prompt ends with the reports of its children ``edges(parent, child)``; those that aren't made anew are in ``known(ts,
    report_string)``.
    """
    from ..functions.text import report_text
    from .graph import cut_lineage

    if known is not None:
        known = known.join(contexts.select("ts"), "ts", "left_anti").select("ts", "report_string")

    def call(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for prompt in pdf["prompt"]:
                for attempt in range(retries):
                    try:
                        out.append(model(prompt))
                        break
                    except Exception:
                        if attempt == retries - 1:
                            raise
            yield pd.DataFrame({"ts": pdf["ts"], "level": pdf["level"], "raw": out})

    done: DataFrame | None = None
    for level in sorted((r[0] for r in contexts.select("level").distinct().collect()), reverse=True):
        rows = contexts.where(F.col("level") == level).select("ts", "level", "packed")
        made_before = None if done is None else done.select("ts", "report_string")
        if known is not None:
            made_before = known if made_before is None else made_before.union(known)
        if made_before is not None:
            below = edges.join(made_before.withColumnRenamed("ts", "child"), "child").groupBy(F.col("parent").alias("ts")).agg(F.array_join(F.array_sort(F.collect_list("report_string")), "\n").alias("below"))
            rows = rows.join(below, "ts", "left").select("ts", "level", F.concat_ws("\n", "packed", "below").alias("packed"))
        raw = rows.withColumnRenamed("packed", "prompt").mapInPandas(call, "ts string, level int, raw string")
        report = repair_report(F.from_json("raw", REPORT))
        made = raw.withColumn("report_json", report).select("ts", "level", report_text(F.col("report_json.title"), F.col("report_json.summary"), F.col("report_json.findings")).alias("report_string"), "report_json")
        done = cut_lineage(made if done is None else done.union(made))
    return done


def pack_sub_reports(subs: DataFrame, budget: int) -> DataFrame:
    """``(parent, packed)``: the reports of a community's parts ``(parent, cluster, occurrence, report_string)``, those of the
    largest occurrence first, within a token budget."""
    order = [F.desc("occurrence"), F.col("cluster")]
    return pack_rows(subs, "parent", ["cluster", "report_string"], order, budget, "id,\tcluster,\treport")


def community_contexts(table: DataFrame, degrees: DataFrame, budget: int = 4000) -> DataFrame:
    """``(ts, level, packed)`` of communities ``(cluster, level, nodes, edges)``, the cluster in place of a time: its nodes by
    degree and its edges by their ends' degrees, half of the budget each."""
    nodes = table.select(F.col("cluster").alias("ts"), "level", F.explode("nodes").alias("node")).join(degrees, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    first = pack_rows(nodes, "ts", ["node", "degree"], [F.desc("degree"), F.col("node")], budget // 2, "id,\tentity,\tdegree")
    pairs = table.select(F.col("cluster").alias("ts"), F.explode("edges").alias("e")).select("ts", "e.src", "e.tgt")
    ranked = pairs.join(degrees.toDF("src", "ds"), "src", "left").join(degrees.toDF("tgt", "dt"), "tgt", "left").withColumn("degree", F.coalesce("ds", F.lit(0)) + F.coalesce("dt", F.lit(0)))
    second = pack_rows(ranked, "ts", ["src", "tgt", "degree"], [F.desc("degree"), F.col("src"), F.col("tgt")], budget // 2, "id,\tsource,\ttarget,\tdegree").withColumnRenamed("packed", "pairs")
    levels = table.select(F.col("cluster").alias("ts"), F.col("level").cast("int").alias("level"))
    return levels.join(first, "ts").join(second, "ts", "left").select("ts", "level", F.concat_ws("\n", F.concat(F.lit("Community "), "ts"), "packed", "pairs").alias("packed"))


def single(reports: DataFrame) -> DataFrame:
    """The one report that a question about a single community gets: the best rated, of equals the largest."""
    return reports.orderBy(F.desc("rating"), F.desc(F.col("n_edges") + F.col("n_nodes")), "ts").limit(1)


def select_reports(reports: DataFrame, level: int, min_rating: float = 0.0, limit: int | None = 512) -> DataFrame:
    """Reports up to a level, the first ``limit`` (None: all) by (level, edges, nodes), of enough rating, then by size
    and rating."""
    rows = reports.where(F.col("level") <= level)
    if limit is not None:
        rows = rows.orderBy("level", F.desc("n_edges"), F.desc("n_nodes"), "ts").limit(limit)
    rows = rows.where(F.coalesce("rating", F.lit(0.0)) >= min_rating)
    return rows.orderBy(F.desc("n_edges"), F.desc("n_nodes"), F.desc("rating"), "ts")


def report_groups(reports: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """``(ts, tokens, group)``: reports in groups that fit the budget one after the other, as ``next_fit`` makes them.

    Partitions hold ranges of the order. How full a group a partition begins with only decides where its first own group
    opens: the driver learns the places that are possible (no more than a budget has tokens) and what follows from each,
    goes through the partitions, and then all are numbered at once.
    """
    from .graph import cut_lineage

    sums = "p int, before array<bigint>, opened array<bigint>, used array<bigint>, total bigint"
    ordered = reports.orderBy(*order).select("ts", "tokens", F.coalesce(F.col("tokens").cast("bigint"), F.lit(0).cast("bigint")).alias("t"), F.spark_partition_id().alias("p"))
    ordered = cut_lineage(ordered)

    def outline(batches):  # noqa: ANN001, ANN202
        parts = [pdf for pdf in batches if len(pdf)]
        if parts:
            t = np.concatenate([pdf["t"].to_numpy() for pdf in parts])
            n, s = len(t), np.append(0, np.cumsum(t))
            after = np.maximum(np.searchsorted(s, s[:-1] + budget, "right") - 1, np.arange(1, n + 1))
            opened, used = np.zeros(n + 1, np.int64), s[-1] - s
            for i in range(n - 1, -1, -1):
                opened[i] = 1 + opened[after[i]]
                if after[i] < n:
                    used[i] = used[after[i]]
            first = np.arange(min(n, int(np.searchsorted(s[1:], budget, "right")) + 1))
            first = first[(t[first] > 0) | (first == 0)]
            yield pd.DataFrame({"p": [int(parts[0]["p"].iloc[0])], "before": [s[first + 1].tolist()], "opened": [opened[first].tolist()], "used": [used[first].tolist()], "total": [int(s[-1])]})

    starts: dict[int, tuple[int, int]] = {}
    used, group = 0, -1
    for r in sorted(ordered.select("p", "t").mapInPandas(outline, sums).collect()):
        starts[r.p] = used, group
        at = 0 if group < 0 or used > budget else next((i for i, x in enumerate(r.before) if used + x > budget), None)
        used, group = (used + r.total, group) if at is None else (r.used[at], group + r.opened[at])

    def number(batches):  # noqa: ANN001, ANN202
        state = None
        for pdf in batches:
            if not len(pdf):
                continue
            used, group = state or starts[int(pdf["p"].iloc[0])]
            out = []
            for x in pdf["t"].tolist():
                opens = group < 0 or used + x > budget
                used, group = (x, group + 1) if opens else (used + x, group)
                out.append(group)
            state = used, group
            yield pdf[["ts", "tokens"]].assign(group=np.array(out, np.int32))

    types = dict(reports.select("ts", "tokens").dtypes)
    return ordered.mapInPandas(number, f"ts {types['ts']}, tokens {types['tokens']}, group int")


def points(groups: DataFrame, answer: str = "response") -> DataFrame:
    """``(analyst, description, score)`` of JSON answers ``{"points": [..]}``: scored over 0 (1 if missing), best first."""
    parsed = groups.select(F.col("group").alias("analyst"), F.from_json(answer, "struct<points:array<struct<description:string,score:double>>>").alias("j"))
    rows = parsed.select("analyst", F.explode("j.points").alias("p")).select("analyst", "p.description", F.coalesce("p.score", F.lit(1.0)).alias("score"))
    return rows.where("description is not null and score > 0").orderBy(F.desc("score"), "analyst", "description")
