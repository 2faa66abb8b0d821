"""Record grammar of extraction responses: splitting, routing, merging into nodes, edges and quadruples.

A response holds records ``("entity"<|>NAME<|>TYPE<|>DESCRIPTION)`` and ``("relationship"<|>TIME<|>SOURCE<|>TARGET<|>
DESCRIPTION)`` separated by ``##`` and closed by ``<|COMPLETE|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_id, sanitize, split_markers
from ..functions.timeexpr import canonical, format_level, level_number, normalize_time, time_end, time_level, time_start
from .graph import by_distinct

# Delimiters of the grammar and of packed fields (fixed values).
FIELD, RECORD, COMPLETE, PACKED = "<|>", "##", "<|COMPLETE|>", "<SEP>"
# Levels that make an entity a time (fixed values).
TIME_TYPES = ["YEAR", "QUARTER", "MONTH", "WEEK", "DATE", "SEASON", "TIMESTAMP"]
UNKNOWN_TIME = "UNKNOWN_TIME"


def records(responses: DataFrame, key: str, response: str) -> DataFrame:
    """``(key, pos, attrs array<string>)`` of every record with three attributes or more."""
    parts = responses.select(key, F.posexplode(split_markers(F.col(response), [RECORD, COMPLETE])).alias("pos", "record"))
    inner = F.regexp_extract("record", "\\((.*)\\)", 1)
    body = F.when(inner == "", F.col("record")).otherwise(inner)
    attrs = F.transform(F.split(body, "\\Q" + FIELD + "\\E"), sanitize)
    return parts.select(key, "pos", attrs.alias("attrs")).where(F.size("attrs") >= 3)


def _attr(i: int) -> Column:
    return F.get(F.col("attrs"), F.lit(i))


def entities(parsed: DataFrame, key: str) -> DataFrame:
    """``(key, pos, entity_name, entity_type, description, is_temporal, granularity)`` of entity records.

    Names and types are upper-cased; times may come without a description, and get their canonical form as a name.
    """
    kind = F.lower(_attr(0))
    rows = parsed.where(kind.contains("entity") & ((F.size("attrs") >= 4) | F.upper(_attr(2)).isin(TIME_TYPES)))
    temporal = F.upper(_attr(2)).isin(TIME_TYPES)
    name = F.when(temporal, canonical(_attr(1))).otherwise(F.upper(_attr(1)))
    rows = rows.select(key, "pos", name.alias("entity_name"), F.upper(_attr(2)).alias("entity_type"), F.coalesce(_attr(3), F.lit("")).alias("description"), temporal.alias("is_temporal"))
    return rows.where("entity_name <> ''").withColumn("granularity", F.when(F.col("is_temporal"), time_level(F.col("entity_name"))))


def relations(parsed: DataFrame, key: str) -> DataFrame:
    """``(key, pos, src, tgt, ts, raw_timestamp, level, description, route)`` of relation records, by three routes.

    ``temporal``: five attributes, the second a time. ``mined``: four, the time found in the description, or unknown.
    ``disguised``: any other record of three attributes or more that isn't an entity; its first two are the ends.
    """
    kind = F.lower(_attr(0))
    is_relation = kind.contains("relationship")
    n = F.size("attrs")
    route = F.when(is_relation & (n >= 5), "temporal").when(is_relation & (n >= 4), "mined").when(~is_relation & ~kind.contains("entity") & (n >= 3), "disguised")
    rows = parsed.withColumn("route", route).where("route is not null")
    mined = F.coalesce(F.nullif(F.regexp_extract(F.upper(F.element_at("attrs", -1)), "([0-9]{4}-Q[1-4]|Q[1-4][ -]?[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}-[0-9]{2}|[0-9]{4})", 1), F.lit("")), F.lit(UNKNOWN_TIME))
    raw = F.when(F.col("route") == "temporal", F.upper(_attr(1))).otherwise(mined)
    at = F.when(F.col("route") == "temporal", 2).when(F.col("route") == "mined", 1).otherwise(0)
    src, tgt = F.upper(F.get("attrs", at)), F.upper(F.get("attrs", at + 1))
    rows = rows.select(key, "pos", src.alias("src"), tgt.alias("tgt"), raw.alias("raw_timestamp"), F.element_at("attrs", -1).alias("description"), "route")
    # few different spellings, many relations: each spelling is normalised once
    rows = by_distinct(rows.where("src <> '' and tgt <> ''"), "raw_timestamp", "ts", lambda x: F.when(x == UNKNOWN_TIME, x).otherwise(canonical(x)))
    level = F.coalesce(level_number(time_level(F.col("ts"))), F.lit(1))
    return rows.select(key, "pos", "src", "tgt", "ts", "raw_timestamp", F.when(F.col("ts") == UNKNOWN_TIME, 1).otherwise(level).alias("level"), "description", "route")


def time_constraints(parsed: DataFrame, key: str) -> DataFrame:
    """``(key, pos, logic, timestamps array, level)`` of query-time records: at, before, after, between.

    The ends of a range of two levels are brought to the finer one: the earlier to the first, the later to the last time of
    that level in it.
    """
    logic = F.lower(_attr(1))
    rows = parsed.where(F.lower(_attr(0)).contains("entity") & logic.isin("at", "before", "after", "between"))
    two = (logic == "between") & (F.size("attrs") >= 5)
    rows = rows.where((logic != "between") | two).select(key, "pos", logic.alias("logic"), two.alias("two"), canonical(_attr(2)).alias("a"), F.when(two, canonical(_attr(3))).alias("b"))
    later = F.col("two") & (time_start(F.col("a")) > time_start(F.col("b")))
    rows = rows.withColumns({"lo": F.when(later, F.col("b")).otherwise(F.col("a")), "hi": F.when(later, F.col("a")).otherwise(F.col("b"))})
    number = lambda c: level_number(time_level(F.col(c)))
    finer = lambda c, day: F.when(F.col("fine") == 3, format_level(day, "date")).when(F.col("fine") == 2, format_level(day, "month")).when(F.col("fine") == 1, format_level(day, "quarter")).otherwise(F.col(c))
    known = (time_level(F.col("lo")) != "unknown") & (time_level(F.col("hi")) != "unknown")
    rows = rows.withColumn("fine", F.greatest(number("lo"), number("hi")))
    lo = F.when(known & (number("lo") < F.col("fine")), finer("lo", time_start(F.col("lo")))).otherwise(F.col("lo"))
    hi = F.when(known & (number("hi") < F.col("fine")), finer("hi", time_end(F.col("hi")))).otherwise(F.col("hi"))
    rows = rows.select(key, "pos", "logic", F.when(F.col("two"), F.array(lo, hi)).otherwise(F.array("a")).alias("timestamps"))
    finest = F.array_max(F.transform("timestamps", lambda t: level_number(time_level(t))))
    return rows.withColumn("level", finest)


def claims(parsed: DataFrame, key: str) -> DataFrame:
    """``(key, pos, subject, object, claim_type, status, start, end, description, quote)`` of claim records of eight fields.

    Subject and object are upper-cased, times get their canonical form; records with fewer fields are dropped.
    """
    rows = parsed.where(F.size("attrs") >= 8)
    name = lambda i: F.upper(_attr(i))
    return rows.select(key, "pos", name(0).alias("subject"), name(1).alias("object"), name(2).alias("claim_type"), name(3).alias("status"), canonical(_attr(4)).alias("start"), canonical(_attr(5)).alias("end"), _attr(6).alias("description"), _attr(7).alias("quote"))


def cooccurring_times(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """``(ts)``: times that stay in the relation graph, of ``edges(ts, src, tgt)`` and ``kinds(name, is_temporal)``.

    An edge speaks for the first of its time, source and target that is a time, if another of its three names is an entity
    that is none. Names without a kind are neither.
    """
    of = lambda c: kinds.select(F.col("name").alias(c), F.col("is_temporal").alias(f"{c}_t"))
    rows = edges.select("ts", "src", "tgt").distinct().join(of("ts"), "ts", "left").join(of("src"), "src", "left").join(of("tgt"), "tgt", "left")
    is_time = lambda c: F.coalesce(F.col(f"{c}_t"), F.lit(False))
    entity = lambda c: F.coalesce(~F.col(f"{c}_t"), F.lit(False))
    spoken = F.when(is_time("ts"), F.when(entity("src") | entity("tgt"), F.col("ts"))).when(is_time("src"), F.when(entity("ts") | entity("tgt"), F.col("src"))).when(is_time("tgt"), F.when(entity("ts") | entity("src"), F.col("tgt")))
    return rows.select(spoken.alias("ts")).where("ts is not null").distinct()


def granularity(parsed: DataFrame, key: str) -> DataFrame:
    """``(key, granularity)`` asked for by ``("granularity"<|>LEVEL)`` records."""
    return parsed.where(F.lower(_attr(0)).contains("granularity")).select(key, F.lower(_attr(1)).alias("granularity"))


def split_granularity(responses: DataFrame, key: str, response: str) -> DataFrame:
    """``(key, granularity)`` of answers to the question for a level: the first record's second attribute."""
    parts = split_markers(F.col(response), [RECORD, COMPLETE])
    inner = F.regexp_extract(F.get(parts, F.lit(0)), "\\((.*)\\)", 1)
    attrs = F.transform(F.split(inner, "\\Q" + FIELD + "\\E"), sanitize)
    return responses.select(key, F.lower(F.get(attrs, F.lit(1))).alias("granularity")).where("granularity is not null and granularity <> ''")


def quadruples(relation_rows: DataFrame, temporal_names: DataFrame, metric: str = "(?i)^(revenue|profit|eps|margin|[$0-9.,% ]+)$") -> DataFrame:
    """``(v1, v2, e, tau, source_id, raw_timestamp)``: relations with a known time, a description, and two ends that are
    neither times nor bare financial metrics. ``temporal_names(entity_name)`` lists the times."""
    good = relation_rows.where(F.col("description").isNotNull() & (F.btrim("description") != "") & (normalize_time(F.col("ts"))["kind"] != "failed"))
    for end in ("src", "tgt"):
        good = good.where(~F.col(end).rlike(metric)).join(temporal_names.select(F.col("entity_name").alias(end)), end, "left_anti")
    return good.select(F.col("src").alias("v1"), F.col("tgt").alias("v2"), F.col("description").alias("e"), F.col("ts").alias("tau"), F.col("chunk_id").alias("source_id"), "raw_timestamp")


def entity_payload(nodes: DataFrame) -> DataFrame:
    """Vector payload of entities: ``(id, entity_name, content)``."""
    return nodes.select(hash_id(F.col("entity_name"), "ent-").alias("id"), "entity_name", F.concat_ws(" ", "entity_name", "description").alias("content"))


def relation_payload(facts: DataFrame) -> DataFrame:
    """Vector payload of relations, one row for each time: ``(id, src, tgt, ts, content)``."""
    key = F.concat_ws("_", "src", "tgt", "ts")
    return facts.select(hash_id(key, "rel-").alias("id"), "src", "tgt", "ts", F.concat_ws(" ", "src", "tgt", "ts", "description").alias("content"))


def summarise(rows: DataFrame, column: str, limit: int, summary: Column) -> DataFrame:
    """Descriptions of ``limit`` tokens or more become ``summary``; shorter ones, and failed summaries, stay."""
    from ..functions.text import token_count

    return rows.withColumn(column, F.when(token_count(F.col(column)) >= limit, F.coalesce(summary, F.col(column))).otherwise(F.col(column)))


def within_bounds(rows: DataFrame) -> DataFrame:
    """Typed relations with a weight from 0 to 1 and an order from 1 to 3; others are dropped."""
    return rows.where(F.col("weight").between(0, 1) & F.col("order").between(1, 3))
