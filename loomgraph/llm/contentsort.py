"""Exact dedup by content sort, with DataFrame functions only.

Texts are normalised (A-Z lower-cased) and range-partitioned by keys: the first characters' bytes, the digest, the identifier and a row
number. Splitters are sampled keys, chosen so that buckets hold about equal bytes; as a key ends with the row, a group
of equal texts is cut like any other run of keys, however large it is. Each bucket goes to one task, which sorts it by the whole
normalised texts (spilling to disk), so equal texts are adjacent; the window over a text's rows compares each whole text with its
neighbour's and tells the row that stays and the rows' number. Texts move once.

A group that lies in several buckets must hold a splitter's digest. Those digests, no more than splitters, are known before the
shuffle; the pieces of their groups (one row a piece, matched by SHA-256) are summed up and broadcast.

Defined results: a null text counts as empty; of equal texts the row of the least (or largest) identifier stays, a null
identifier only where there is no other, and of rows that repeat one identifier the first read; further columns aren't read; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of the normalised text that lead the order, sampled keys a bucket, and bytes of text that fill a bucket.
HEAD, SAMPLE, BUCKET_BYTES = 8, 40, 64_000_000
_LAST = (1 << 63) - 1


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def splitters(keys: list[tuple[str, int]], parts: int) -> list[str]:
    """At most ``parts`` - 1 keys that cut the sampled (key, bytes) into runs of about equal bytes."""
    total, run, found = sum(size for _, size in keys), 0, []
    for key, size in sorted(keys):
        if run * parts >= total * (len(found) + 1) and (not found or found[-1] < key):
            found.append(key)
        run += size
    return found


def bucket_of(key: Column, cuts: list[str]) -> Column:
    """How many of the sorted ``cuts`` are at or below ``key``, by bisection: each step tries to go on by a power of two."""
    if not cuts:
        return F.lit(0)
    cut = F.split(F.lit(",".join(cuts)), ",")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    onward = lambda at, step: (at + step <= len(cuts)) & (F.get(cut, at + step - 1) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(onward(at, step), at + step).otherwise(at))


def dedup(docs: DataFrame, *, keep: str = "least", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256 (of the normalised
    text). ``keep``: ``least`` or ``largest``."""
    if keep not in ("least", "largest"):
        raise ValueError(f"keep is least or largest, not {keep}")
    spark = docs.sparkSession
    ids = F.col("doc_id") if keep == "least" else F.bitwise_not(F.col("doc_id"))
    order = F.struct(F.coalesce(ids, F.lit(_LAST)).alias("rank"), F.col("doc_id").isNull().alias("no_id"), "row", "doc_id")
    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))

    def keyed(rows: DataFrame) -> DataFrame:
        """With the normalised text, its digest and a key whose order as a string is the order of the content sort."""
        rows = rows.withColumn("norm", lower_ascii(F.col("text"))).drop("text").withColumn("text_sha256", F.sha2("norm", 256)).withColumn("at", order)
        head = F.rpad(F.lower(F.hex(F.substring("norm", 1, HEAD).cast("binary"))), 8 * HEAD, "0")
        unsigned = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
        return rows.withColumn("key", F.concat(head, "text_sha256", unsigned(F.col("at.rank").bitwiseXOR(F.lit(-1 - _LAST))), unsigned(F.col("row"))))

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = min(1.0, SAMPLE * max(parts, 100) / max(docs.count(), 1))
    sampled = [(r.key, r.size) for r in keyed(read.where(F.rand(7) < share)).select("key", (F.octet_length("norm") + 64).alias("size")).collect()]
    parts = max(1, min(len(sampled), max(parts, int(sum(size for _, size in sampled) / share / BUCKET_BYTES))))
    cuts = splitters(sampled, parts)
    cut_digests = sorted({key[8 * HEAD : 8 * HEAD + 64] for key in cuts})

    dealt = keyed(read).withColumn("bucket", bucket_of(F.col("key"), cuts)).drop("key", "doc_id", "row").repartitionById(len(cuts) + 1, "bucket")
    piece = Window.partitionBy("bucket", "norm")
    held = materialise(dealt.withColumn("stays", F.first("at").over(piece.orderBy("at"))).withColumn("n", F.count(F.lit(1)).over(piece)).select("at", "stays", "n", "text_sha256"))

    first_rows = held.where("at.row = stays.row").join(F.broadcast(spark.createDataFrame([(d,) for d in cut_digests], "text_sha256 string")), "text_sha256", "left_semi")
    whole = first_rows.groupBy("text_sha256").agg(F.min("stays").alias("_stays"), F.sum("n").alias("_n"))  # no more rows than splitters
    told = held.join(F.broadcast(whole), "text_sha256", "left").withColumn("stays", F.coalesce("_stays", "stays"))
    return told.select(F.col("at.doc_id").alias("doc_id"), F.col("stays.doc_id").alias("keep_id"), F.coalesce("_n", "n").cast("bigint").alias("group_size"), (F.col("at.row") == F.col("stays.row")).alias("kept"), "text_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), keep="largest")


ORACLE_SQL = f"""with d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') t from documents)
select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size, doc_id = max(doc_id) over (partition by t) kept, sha256(t) text_sha256 from d"""
