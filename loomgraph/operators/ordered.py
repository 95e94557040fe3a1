"""Folds over a total order, without a task that holds all rows: state that is carried on, masks in turn, batches."""

from __future__ import annotations

from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.supervision import numbered
from loomgraph.sinks.workspace import new_path
from loomgraph.sources.tables import small


def carried(rows: DataFrame, order: list[str], last: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with, for each name in ``last``, the last value that isn't null of its column up to the row, and for each in
    ``before`` the value at the row before, in the total ``order``.

    Ranges of the order are sorted and written once; within a range windows go on, and what a range starts with comes from the
    ranges before it, of which a row each is enough."""
    last, before = last or {}, before or {}
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    path = new_path(rows.sparkSession, "carried")
    named = rows.withColumns({f"_v_{name}": c for name, c in (last | before).items()})
    named.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    held = rows.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_row", 33))
    here, earlier = Window.partitionBy("_part").orderBy("_row"), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = held.groupBy("_part").agg(
        *(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_row"))).alias(f"_e_{n}") for n in last),
        *(F.max_by(F.struct(f"_v_{n}"), "_row").alias(f"_e_{n}") for n in before), F.count(F.lit(1)).alias("_n"),
    )
    starts = ends.select("_part", *(F.last(f"_e_{n}", True).over(earlier).alias(f"_s_{n}") for n in (*last, *before)))
    told = held.join(F.broadcast(starts), "_part")
    first = F.lag("_row").over(here).isNull()
    values = {n: F.coalesce(F.last(f"_v_{n}", True).over(here), F.col(f"_s_{n}")) for n in last}
    values |= {n: F.when(first, F.col(f"_s_{n}")[f"_v_{n}"]).otherwise(F.lag(f"_v_{n}").over(here)) for n in before}
    return told.withColumns(values).select(*rows.columns, *values)


def family_rows(rows: DataFrame, order: list[str], family: Column, speaks: Column, text: str = "text") -> DataFrame:
    """family, text of the rows of non-blank ``text`` that speak (``speaks``), under the last family named so far (``family``, null in
    rows that name none); where it isn't that of the row emitted before, the text right before comes first. With the columns of
    ``order`` and ``part``: 0 for that text, 1 for the row itself. Rows before any family are left out."""
    there = rows.where(F.trim(text) != "").withColumn("_speaks", F.coalesce(speaks, F.lit(False)))
    known = carried(there, order, last={"family": family}, before={"previous": F.col(text)}).where("_speaks and family is not null")
    turned = carried(known, order, before={"family_before": F.col("family")})
    own = F.struct(F.lit(1).alias("part"), F.col(text).alias("text"))
    both = F.when(F.col("family_before").eqNullSafe(F.col("family")), F.array(own)).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.col("previous").alias("text")), own))
    return turned.select(*order, "family", F.explode(both).alias("e")).select(*order, "family", "e.part", F.trim("e.text").alias("text"))


HEAD, TAIL = " head ", " tail "


def _in_turn(tokens: list, ends: list[tuple]) -> tuple[list, list]:
    """The places of each head and tail, and the tokens afterwards; one pass over the tokens, then a step for each end."""
    wanted = {w for pair in ends for w in pair}
    free: dict[str, list[int]] = {w: [] for w in wanted}  # of each end the places not yet taken, a heap
    for i, w in enumerate(tokens):
        if w in wanted:
            free[w].append(i)
    words, found = list(tokens), []
    for pair in ends:
        at = []
        for end, mark in zip(pair, (HEAD, TAIL), strict=True):
            i = None if end is None else heappop(free[end]) if free[end] else -1
            if i is not None and i >= 0:
                words[i] = mark
                if mark in wanted:
                    heappush(free[mark], i)
            at.append(i)
        found.append(at)
    return words, found


def masked_in_turn(rows: DataFrame, tokens: str, ends: str) -> DataFrame:
    """``rows`` with ``ends`` (an array of structs with head and tail) taken one after the other: ``found``, the ends with head_idx and
    tail_idx, the first places of both among the tokens, -1 where there is none, and ``masked``, the tokens after all of them. A
    token that has been an end is ``' head '`` or ``' tail '`` from then on, so no later end finds it again."""
    kind = rows.schema[ends].dataType.elementType

    @F.arrow_udf("struct<words:array<string>,head_idx:array<bigint>,tail_idx:array<bigint>>")
    def run(words: pa.Array, heads: pa.Array, tails: pa.Array) -> pa.Array:
        out: tuple[list, list, list] = ([], [], [])
        for k in range(len(words)):  # a row at a time: a sentence may have very many ends
            w, h, t = (c[k].as_py() for c in (words, heads, tails))
            made = (None, None, None)
            if w is not None and h is not None:
                masked, found = _in_turn(w, list(zip(h, t, strict=True)))
                made = (masked, [i for i, _ in found], [j for _, j in found])
            for column, value in zip(out, made, strict=True):
                column.append(value)
        return pa.StructArray.from_arrays([pa.array(c, pa.list_(v)) for c, v in zip(out, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["words", "head_idx", "tail_idx"])

    made = rows.withColumn("_made", run(F.col(tokens).cast("array<string>"), F.col(ends)["head"], F.col(ends)["tail"]))
    placed = F.transform(F.arrays_zip(F.col(ends).alias("e"), F.col("_made.head_idx").alias("i"), F.col("_made.tail_idx").alias("j")), lambda z: F.struct(*(z["e"][f.name].alias(f.name) for f in kind), z["i"].alias("head_idx"), z["j"].alias("tail_idx")))
    return made.withColumns({"found": placed, "masked": F.col("_made.words")}).drop("_made")


def mini_batches(rows: DataFrame, key: list[str], size: int = 64, seed: int | None = None) -> DataFrame:
    """``rows`` with ``batch`` and ``place``, both from 0: every batch but the last has ``size`` rows. The order is that of a digest of
    ``seed`` and the ``key`` columns, or of the key alone without a seed (as for evaluation); it depends on nothing else, so it
    is the same in every run and after a lost executor. Rows of one key are next to each other."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key)))
    ordered = rows.withColumn("_digest", digest if seed is not None else F.lit(""))
    told = numbered(ordered, ["_digest", *key], "_n")
    return told.withColumns({"batch": F.expr(f"_n div {size}").cast("bigint"), "place": (F.col("_n") % size).cast("bigint")}).drop("_digest", "_n")


#: Hexadecimal digits of a digest by which rows are counted before a split.
_DIGITS = 3


def stratified_split(rows: DataFrame, by: str, key: str | Column) -> DataFrame:
    """70 / 10 / 20 of each class in the order of a digest of the key. Rows of each class are counted by the first digits of the
    digest; only those whose digits both sides of a cut share are sorted, so ``rows`` are read again but never moved as a whole."""
    key = F.col(key) if isinstance(key, str) else key
    told = rows.withColumn("_digest", F.md5(key.cast("string"))).withColumn("_bucket", F.conv(F.substring("_digest", 1, _DIGITS), 16, 10).cast("int"))
    told = told.withColumn("_bucket", F.coalesce("_bucket", F.lit(-1)))  # a key that is null comes first
    counts = _written(told.groupBy(F.col(by).alias("_class"), "_bucket").agg(F.count(F.lit(1)).alias("_n")), "split")
    running = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_class").orderBy("_bucket")))  # 16^3 + 1 rows a class
    sizes = counts.groupBy("_class").agg(F.sum("_n").alias("_size"))
    running = running.join(sizes, running["_class"].eqNullSafe(sizes["_class"])).select(running["_class"], "_bucket", "_n", "_upto", *(F.floor(F.col("_size") * F.lit(share)).alias(f"_cut{k}") for k, share in enumerate((0.7, 0.8))))
    # for each cut the first bucket that reaches it, none if it is at 0; its rows are all on one side if the bucket ends there
    held = lambda k: F.when(F.col(f"_cut{k}") > 0, F.min(F.when(F.col("_upto") >= F.col(f"_cut{k}"), F.struct("_bucket", (F.col("_upto") - F.col("_n")).alias("before"))))).alias(f"_at{k}")
    cuts = small(running.groupBy("_class", "_cut0", "_cut1").agg(held(0), held(1)))
    placed = told.join(cuts, F.col(by).eqNullSafe(F.col("_class")))
    bucket, at = F.col("_bucket"), [F.coalesce(F.col(f"_at{k}._bucket"), F.lit(-2)) for k in (0, 1)]
    shared = (bucket == at[0]) | (bucket == at[1])
    clear = placed.where(~shared).select(*rows.columns, F.when(bucket < at[0], "train").when(bucket < at[1], "dev").otherwise("eval").alias("split"))
    near = placed.where(shared).withColumns({"_key": key, "_lead": F.when(bucket == at[0], F.col("_at0.before")).otherwise(F.col("_at1.before"))})
    ordered = numbered(near.drop("_at0", "_at1"), [by, "_digest", "_key"], "_k")
    groups = ordered.groupBy("_class", "_bucket").agg(F.min("_k").alias("_first")).withColumnsRenamed({"_class": "_c", "_bucket": "_b"})
    within = ordered.join(small(groups), F.col("_class").eqNullSafe(F.col("_c")) & (F.col("_bucket") == F.col("_b")))
    place = F.col("_lead") + F.col("_k") - F.col("_first") + 1
    return clear.unionByName(within.select(*rows.columns, F.when(place <= F.col("_cut0"), "train").when(place <= F.col("_cut1"), "dev").otherwise("eval").alias("split")))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
