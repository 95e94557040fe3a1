"""Text sinks. Each writes folders of part files, one task a file, except the documents that are one object by nature
(a map, a node-link graph), whose size their sources bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def json_lines(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> str:
    """A JSON object a line; a folder for each value of ``by`` (train, dev, eval)."""
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).json(path)
    return path


def csv_table(df: DataFrame, path: str) -> str:
    """With a header and without an index; arrays, maps and structs as JSON."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType | MapType | StructType)]
    flat = df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns))
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def map_object(df: DataFrame, key: str, value: str, path: str) -> str:
    """One JSON object of all rows, as a relation or entity dictionary is; a null key is written as ``null``. The rows are
    in one value, so this is for dictionaries."""
    entries = F.sort_array(F.collect_list(F.struct(F.coalesce(F.col(key), F.lit("null")).alias("k"), F.col(value).alias("v"))))
    df.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def vocabulary_lines(df: DataFrame, path: str) -> str:
    """``tag:name`` lines in the order of tag and name over all files."""
    df.select(F.concat_ws(":", "tag", "name").alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)
    return path


def lines(df: DataFrame, value: str, path: str) -> str:
    df.select(F.col(value).cast("string").alias("value")).write.mode("overwrite").text(path)
    return path


def node_link(nodes: DataFrame, links: DataFrame, path: str) -> str:
    """One node-link document of nodes (id, name, color, radius) and links (source, target, weight), for a page to draw."""
    made = nodes.agg(F.sort_array(F.collect_list(F.struct("id", "name", "color", "radius"))).alias("nodes"))
    ends = links.agg(F.sort_array(F.collect_list(F.struct("weight", "source", "target"))).alias("links"))
    whole = F.struct(F.lit(False).alias("directed"), F.lit(False).alias("multigraph"), "nodes", "links")
    made.crossJoin(ends).select(F.to_json(whole).alias("value")).coalesce(1).write.mode("overwrite").text(path)  # a row each
    return path


def metrics(df: DataFrame, path: str) -> str:
    df.write.mode("append").parquet(path)
    return path
