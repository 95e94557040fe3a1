"""Readers with explicit schemas; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.sinks.workspace import new_path

SPO = "text string, postag array<struct<word:string,pos:string>>, spo_list array<struct<predicate:string,subject:string,object:string,subject_type:string,object_type:string>>"
CANDIDATES = "s string, r string, o string, candidate_entity array<string>"
SCHEMA_ROWS = "subject_type string, predicate string, object_type string"
NODE_LINK = "directed boolean, multigraph boolean, nodes array<struct<id:bigint,name:string,color:string,radius:double>>, links array<struct<weight:bigint,source:bigint,target:bigint>>"

#: Rows and bytes (as written) up to which a dictionary may be broadcast; larger ones are left to a shuffled join.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, least: int = 0) -> DataFrame:
    """``df`` as it is if its rows lie in about as many parts as there are cores, and else dealt out evenly: a file of one row group is
    one task, however large. Up to ``least`` rows stay as they are. Rows are counted by the file's metadata."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return df if sum(rows) <= least or max(rows, default=0) * cores <= 2 * sum(rows) else df.repartition(4 * cores)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written once and read back, marked for broadcast if its rows and bytes are few enough. What has been through
    here comes back as it is, so a dictionary that several joins use is made and measured once."""
    if getattr(df, "_measured", False):
        return df
    path = new_path(df.sparkSession, "small")
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    fits = int(str(held._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= size and held.count() <= rows
    held = F.broadcast(held) if fits else held
    held._measured, held._fits = True, fits
    return held


def is_broadcast(df: DataFrame) -> bool:
    """Whether ``small`` found that ``df`` fits into every task."""
    return getattr(df, "_fits", False)


def triples(spark: SparkSession, path: str) -> DataFrame:
    """s, r, o of a tab-separated statement file; prefix and comment lines carry no tab and fall out."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("@")) & (F.size(parts) >= 3))
    return lines.select(T.strip_entity(parts[0]).alias("s"), T.strip_relation(parts[1]).alias("r"), T.strip_entity(parts[2]).alias("o"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(CANDIDATES).json(path)
    return raw.select(T.strip_entity(F.col("s")).alias("s"), T.strip_relation(F.col("r")).alias("r"), T.strip_entity(F.col("o")).alias("o"), F.transform("candidate_entity", lambda c: F.regexp_replace(c, "^e:", "")).alias("candidate_entity"))


def markup_files(spark: SparkSession, path: str, glob: str = "*.xhtml") -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return raw.select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "").alias("title"), F.col("value").alias("html"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """id, label: a row for each of several labels; the last line of an id wins, over all files in the order of their paths, however
    they are split for reading."""
    raw = spark.read.option("sep", "\t").schema("id string, label string").csv(path)
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    last = raw.select("id", "label", at.alias("at")).groupBy("id").agg(F.max_by("label", "at").alias("label"))
    return last.select("id", F.explode_outer(F.split("label", " ").cast("array<int>")).alias("label"))


def sentences(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("sep", "\t").option("quote", "").schema("id string, head string, tail string, sentence string").csv(path)
    return raw.select("id", "head", "tail", F.split("sentence", " ").alias("token"))


def statements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPO).json(path).select(F.lower("text").alias("sentence"), F.col("postag.word").alias("tokens"), F.explode_outer("spo_list").alias("spo"))


def node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.option("multiLine", True).schema(NODE_LINK).json(path)
    return raw.select(F.inline("nodes")), raw.select(F.inline("links"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """tag, name; a name may hold further colons."""
    parts = F.split(F.regexp_replace("value", "\r$", ""), ":", 2)
    return spark.read.text(path).select(parts[0].alias("tag"), parts[1].alias("name"))


def free_rows(spark: SparkSession, path: str) -> DataFrame:
    """content, title, id of JSON lines (bare NaN read as ``none``) or, of any other file, of its lines, with ``none``."""
    name = path.rstrip("/")
    raw = spark.read.text(path)
    if name.endswith((".json", ".jsonl")):
        return raw.select(F.from_json(T.none_for_nan(F.col("value")), "content string, title string, id string").alias("r")).select("r.*")
    if name.endswith(".txt"):
        return raw.select(F.col("value").alias("content"), F.lit("none").alias("title"), F.lit("none").alias("id"))
    raise ValueError(f"neither JSON lines nor text: {path}")


def long_items(spark: SparkSession, items: list[str], longer_than: int = 20) -> DataFrame:
    return spark.createDataFrame([(x,) for x in items], "content string").where(F.length("content") > longer_than)


def stopwords(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """The words of a one-column list in the order of its lines, the ellipsis after them; only the ``first`` lines if given.
    A list is one file, so its lines are numbered by the reader's own order."""
    numbered = spark.read.text(path).select(F.col("value").alias("word"), F.monotonically_increasing_id().alias("n"))
    kept = numbered if first is None else numbered.orderBy("n").limit(first)
    return kept.select("word").unionByName(spark.createDataFrame([("…",)], "word string"))


def optional_list(spark: SparkSession, path: str, log: bool = False) -> DataFrame:
    """The lines of a file, none if it isn't there; of a log the part after the last ``>>``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "word string")
    value = F.col("value")
    return spark.read.text(path).select((T.last_after(value) if log else value).alias("word"))


def relation_table(spark: SparkSession, path: str) -> DataFrame:
    """head_type, tail_type, relation, id of a schema file; id 0 is no relation. A schema is of tens of rows."""
    raw = spark.read.schema(SCHEMA_ROWS).json(path).select(F.col("subject_type").alias("head_type"), F.col("object_type").alias("tail_type"), F.col("predicate").alias("relation"))
    numbered = raw.withColumn("id", F.row_number().over(Window.orderBy("head_type", "relation", "tail_type")))
    return spark.createDataFrame([("None", "None", None, 0)], "head_type string, tail_type string, relation string, id int").unionByName(numbered)


def samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def codebook(spark: SparkSession, path: str) -> DataFrame:
    """relation path, id and the path's leaf."""
    raw = spark.read.option("sep", "\t").schema("relation string, id int").csv(path)
    return raw.withColumn("leaf", T.path_leaf(F.col("relation")))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """key, value of one JSON object; the key ``null`` is no relation."""
    raw = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("key", "value"))
    return raw.select(F.when(F.col("key") != "null", F.col("key")).alias("key"), "value")
