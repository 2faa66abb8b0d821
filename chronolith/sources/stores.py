"""Stores of other tools as tables: JSON key-value files, JSON vector files, GraphML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import restored_map, stored_attribute


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def json_store(spark: SparkSession, path: str, value: str = "map<string,string>") -> DataFrame:
    """``(id, value)`` of a JSON file that holds one object, key to record; of a missing file, no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"id string, value {value}")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return whole.select(F.explode("m").alias("id", "value"))


def write_json_store(rows: DataFrame, path: str) -> None:
    """JSON lines ``{"id": .., "value": ..}`` of ``(id, value)``: a table has no one object, whatever its size."""
    rows.select(F.to_json(F.struct("id", "value")).alias("value")).write.mode("overwrite").text(path)


def vector_store(spark: SparkSession, path: str) -> DataFrame:
    """``(id, embedding array<float>, attributes)`` of a JSON object ``{"data": [{"id", "vector", ..}]}`` or a list of those."""
    record = "struct<id:string,vector:array<float>,embedding:array<float>,entity_name:string,content:string>"
    whole = spark.read.text(path, wholetext=True)
    rows = F.coalesce(F.from_json("value", f"struct<data:array<{record}>>")["data"], F.from_json("value", f"array<{record}>"))
    found = whole.select(F.explode(rows).alias("r"))
    return found.select("r.id", F.coalesce("r.vector", "r.embedding").alias("embedding"), "r.entity_name", "r.content")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file: ``(id, attributes)`` and ``(src, tgt, attributes)``, attributes by their names as maps.

    Values that hold JSON objects stay text; ``restored_map`` makes maps of them.
    """
    data = "data array<struct<_VALUE:string,_key:string>>"
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    keys = read("key", "_id string, `_attr.name` string")
    names = {r[0]: r[1] for r in keys.collect()}  # as many as a graph has attributes
    named = F.create_map(*[F.lit(x) for kv in (names or {"": ""}).items() for x in kv])
    attributes = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_VALUE:string,_key:string>>")), lambda d: F.struct(F.coalesce(F.element_at(named, d["_key"]), d["_key"]).alias("key"), F.coalesce(d["_VALUE"], F.lit("")).alias("value"))))
    nodes = read("node", f"_id string, {data}").select(F.col("_id").alias("id"), attributes.alias("attributes"))
    edges = read("edge", f"_source string, _target string, {data}").select(F.col("_source").alias("src"), F.col("_target").alias("tgt"), attributes.alias("attributes"))
    return nodes, edges


def stored(df: DataFrame) -> DataFrame:
    """All columns as a graph file would hold them."""
    return df.select(*[stored_attribute(F.col(f"`{n}`"), t).alias(n) for n, t in df.dtypes])


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that hold JSON objects as maps again."""
    return df.withColumns({c: restored_map(F.col(f"`{c}`")) for c in columns})
