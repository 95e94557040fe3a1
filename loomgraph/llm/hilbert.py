"""Sharding along a Hilbert curve, with DataFrame functions only.

Four metadata dimensions (language, source, size, identifier) are quantised to ``bits`` bits each; the curve index of
that cell orders the rows, so that rows near each other in every dimension share a shard and a reader can prune files
by any of them. Equal texts form a group that takes the least index of its members and stays together in the order.
The order is cut into ``shards`` runs under the law ``rows``: counts differ by at most one. A group is split only
where a cut falls inside it, as a group may be larger than a shard.

The global position needs no single-partition window: rows are range-partitioned by (index, text key, identifier,
row key), written once, and each partition's offset is the sum of the counts before it (one row per partition).

Defined results: a null text has no bytes and the checksum 0; a null identifier, language or source takes the
lowest cell; repeated rows are rows like others and get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

DIMENSIONS, BITS, SHARDS = 4, 8, 24
#: The share of rows, as a divisor, from which a group counts as large.
COMMON = 1000


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def _trailing_ones(i: int) -> int:
    return 0 if not i & 1 else 1 + _trailing_ones(i >> 1)


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """Entry point and direction of each of the 2^n subcells, by the closed forms for Hilbert curves in n dimensions."""
    entry = [0 if w == 0 else _gray(2 * ((w - 1) // 2)) for w in range(1 << n)]
    turn = [0 if w == 0 else _trailing_ones(w - 1 if w % 2 == 0 else w) % n for w in range(1 << n)]
    return entry, turn


def curve_index(cells: list[Column], bits: int) -> Column:
    """Hilbert index of integer coordinates below 2^bits, most significant level first."""
    n = len(cells)
    full = (1 << n) - 1
    entry, turn = (F.array(*map(F.lit, t)) for t in curve_tables(n))
    turned_left = lambda x, k: F.expr("0") if x is None else (F.call_function("shiftleft", x, k).bitwiseOR(F.call_function("shiftright", x, F.lit(n) - k))).bitwiseAND(F.lit(full))
    turned_right = lambda x, k: (F.call_function("shiftright", x, k).bitwiseOR(F.call_function("shiftleft", x, F.lit(n) - k))).bitwiseAND(F.lit(full))

    def level(state: Column, at: Column) -> Column:
        corner = sum((F.call_function("shiftleft", F.call_function("shiftright", c, at).bitwiseAND(F.lit(1)), F.lit(k)) for k, c in enumerate(cells[1:], 1)), F.call_function("shiftright", cells[0], at).bitwiseAND(F.lit(1)))
        gray = turned_right(corner.bitwiseXOR(state["e"]), state["d"] + 1)
        sub = gray
        for k in range(1, n):
            sub = sub.bitwiseXOR(F.call_function("shiftright", gray, F.lit(k)))
        # the subcell goes through a struct of its own, so that it is computed once a level
        return F.struct(sub.alias("w"), state["h"].alias("h"), state["e"].alias("e"), state["d"].alias("d"))

    def step(state: Column, at: Column) -> Column:
        return F.element_at(
            F.transform(
                F.array(level(state, at)),
                lambda s: F.struct(
                    (s["h"] * F.lit(1 << n) + s["w"]).cast("bigint").alias("h"),
                    s["e"].bitwiseXOR(turned_left(F.element_at(entry, s["w"] + 1), s["d"] + 1)).alias("e"),
                    F.pmod(s["d"] + F.element_at(turn, s["w"] + 1) + 1, F.lit(n)).cast("int").alias("d"),
                ),
            ),
            1,
        )

    levels = F.array(*(F.lit(i) for i in reversed(range(bits))))
    start = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(levels, start, step, lambda s: s["h"])


def _with_group_curve(placed: DataFrame) -> DataFrame:
    """``placed`` with the least curve index of its text's group. Groups of a thousandth of the rows or more, a thousand at most,
    come by broadcast, so that no task gets one; others by a join; a text that occurs once needs neither."""
    group = ["text_key", "text_crc32", "size"]
    groups = materialise(placed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("curve").alias("group_curve")).where("n > 1"))
    is_large = F.col("n") * COMMON >= placed.count()
    large, small = groups.where(is_large).drop("n"), groups.where(~is_large).select(*group, F.col("group_curve").alias("_small"))
    told = placed.join(F.broadcast(large), group, "left")
    rest = told.where("group_curve is null").drop("group_curve").join(small, group, "left")
    return told.where("group_curve is not null").unionByName(rest.withColumn("group_curve", F.coalesce("_small", "curve")).drop("_small"))


def shard(docs: DataFrame, *, shards: int = SHARDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law isn't ``key``),
    curve_index."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    top = (1 << bits) - 1
    base = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
        F.coalesce(F.crc32(F.col(lang_col).cast("binary")) % top + 1, F.lit(0)).cast("int").alias("c0"),
        F.coalesce(F.crc32(F.col(source_col).cast("binary")) % top + 1, F.lit(0)).cast("int").alias("c1"),
        F.least(F.floor(F.log2(F.octet_length(text) + F.lit(1.0)) * 10), F.lit(top)).cast("int").alias("c2"),
    )
    base = materialise(base)  # the texts are read once
    low, high = base.agg(F.min("doc_id"), F.max("doc_id")).first()
    span = max((high or 0) - (low or 0), 1)
    cell = F.coalesce(F.floor((F.col("doc_id").cast("double") - F.lit(float(low or 0))) / F.lit(float(span)) * top), F.lit(0)).cast("int")
    placed = base.withColumn("c3", cell).withColumn("curve", curve_index([F.col(f"c{i}") for i in range(DIMENSIONS)], bits)).drop("c0", "c1", "c2", "c3")
    order = ["group_curve", "text_key", "doc_id", "curve"]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = _with_group_curve(placed).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = materialise(ordered.select("doc_id", "size", "text_crc32", "curve", F.monotonically_increasing_id().alias("row")))
    part, within = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row per partition
    total = F.lit(numbered.count()).cast("bigint")
    at = numbered.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("at", F.col("before") + within)
    cut = F.expr(f"cast((at * {shards}) div greatest(total, 1) as int)")
    start = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return at.withColumn("total", total).withColumn("shard", cut).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - start).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("curve").alias("curve_index"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
