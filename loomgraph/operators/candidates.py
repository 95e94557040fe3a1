"""Candidates for a literal's entity: similar names, their skyline, and the choice of one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import similar as N
from loomgraph.functions import text as T

#: Names of the second table that go out with one pass over the first, and names of the first compared with them at once.
BLOCK, AT_ONCE = 20_000, 64


def similar_pairs(left: DataFrame, right: DataFrame, least: float, substring: bool = True) -> DataFrame:
    """l, r, distance, lcs, like of the pairs of distinct names (``name`` of both tables) that are more than ``least`` alike: by
    Levenshtein ratio plus, with ``substring``, the longest common substring over both lengths. Null names pair with nothing.

    The second table is dealt into blocks of about ``BLOCK`` names, each is broadcast to one pass over the first. In a pass the code
    points that two names share bound what they can reach from above: only pairs within the bound are compared, none is lost."""
    names = lambda df: df.where("name is not null").select("name").distinct()
    left, right = names(left), names(right)
    blocks = max(1, -(-right.count() // BLOCK))
    found = None
    for k in range(blocks):
        block = [r.name for r in right.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k).collect()]
        sent = left.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            b, lb = N.code_points(sent.value, -2)
            counts, words = N.class_counts(b, lb), pa.array(sent.value, pa.string())
            for batch in batches:
                for at in range(0, batch.num_rows, AT_ONCE):
                    own = batch.column(0).slice(at, AT_ONCE)
                    a, la = N.code_points(own.to_pylist(), -1)
                    longer, both = np.maximum(np.maximum(la[:, None], lb), 1), np.maximum(la[:, None] + lb, 1)
                    shared = N.shared_at_most(N.class_counts(a, la), counts)
                    most = shared / longer + (shared / both if substring else 0)
                    i, j = np.nonzero((most > least - 1e-9) | ((la[:, None] == 0) & (lb == 0)))
                    distance, longest = N.distance_and_substring(a[i], la[i], b[j], lb[j])
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(i)), words.take(pa.array(j)), pa.array(distance), pa.array(longest)], ["l", "r", "distance", "lcs"])

        part = left.mapInArrow(run, "l string, r string, distance bigint, lcs bigint")
        found = part if found is None else found.unionByName(part)
    longest, both = F.greatest(F.length("l"), F.length("r"), F.lit(1)), F.greatest(F.length("l") + F.length("r"), F.lit(1))
    like = ((longest - F.col("distance")) * both + F.col("lcs") * longest) / (longest * both) if substring else F.lit(1.0) - F.col("distance") / longest
    return found.withColumn("like", like).where(F.col("like") > least)


def literal_candidates(triples: DataFrame, entities: DataFrame, strong: float = 0.4, weak: float = 0.1) -> DataFrame:
    """s, r, o, e, sim_o, sim_s, tier: for the tail of each triple every entity (``name``) that is more than ``strong`` like
    both ends; where there is none, the one of those more than ``weak`` like both with the greatest sum, the first of equals."""
    ends = triples.select("s", "o").distinct()
    both = triples.select(F.col("s").alias("name")).unionByName(triples.select(F.col("o").alias("name")))
    near = similar_pairs(both, entities, weak)
    like = lambda end: near.select(F.col("l").alias(end), F.col("r").alias("e"), F.col("like").alias(f"sim_{end}"))
    found = ends.join(like("o"), "o").join(like("s"), ["s", "e"])
    one = F.struct("e", "sim_o", "sim_s")
    whole = lambda c: T.fixed(F.col(c)) * 1_000_000
    best = F.min(F.struct((-F.round(whole("sim_o")) - F.round(whole("sim_s"))).cast("bigint").alias("k"), "e", one.alias("one")))["one"]
    sure = F.collect_list(F.when((F.col("sim_o") > strong) & (F.col("sim_s") > strong), one))
    chosen = found.groupBy("s", "o").agg(sure.alias("sure"), best.alias("best"))
    tier = F.when(F.size("sure") > 0, "candidate").otherwise("fallback").alias("tier")
    rows = chosen.select("s", "o", tier, F.explode(F.when(F.size("sure") > 0, F.col("sure")).otherwise(F.array("best"))).alias("c"))
    return triples.join(rows, ["s", "o"]).select("s", "r", "o", "c.e", T.fixed(F.col("c.sim_o")).alias("sim_o"), T.fixed(F.col("c.sim_s")).alias("sim_s"), "tier")


def skyline(points: DataFrame, by: list[str], attributes: list[str]) -> DataFrame:
    """The rows of ``points`` that no row of the same ``by`` is at least as good as in every attribute and better in one; more is better.
    Equal rows stay together, and a null attribute is neither better nor worse than anything.

    Rows are read in descending order of their attributes, so what dominates a row comes before it, and only the skyline so far is
    held. Each task first does that with the rows it has, before anything moves; then what is left of a group meets."""
    order = [*by, *(F.desc_nulls_last(a) for a in attributes)]
    kept = points.columns
    held = points.select(F.struct(*kept).alias("row"), F.struct(*by).alias("group"), *(F.col(a).cast("double").alias(f"a{k}") for k, a in enumerate(attributes)), *by, *(a for a in attributes if a not in by))
    width = len(attributes)

    def run(batches):
        group, best = None, np.empty((0, width))
        for batch in batches:
            groups = batch.column(1).to_pylist()
            values = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(width)], axis=1).astype(float)
            keep = np.ones(len(groups), bool)
            for k, own in enumerate(groups):
                if own != group:
                    group, best = own, np.empty((0, width))
                worse = (best >= values[k]).all(1)
                if (worse & (best > values[k]).any(1)).any():
                    keep[k] = False
                elif not worse.any() and not np.isnan(values[k]).any():
                    best = np.vstack([best, values[k]])
            yield batch.filter(pa.array(keep))

    local = held.sortWithinPartitions(*order).mapInArrow(run, held.schema)
    return local.repartition(*by).sortWithinPartitions(*order).mapInArrow(run, held.schema).select("row.*")


def lower_bound(points: DataFrame, by: list[str], attributes: list[str], two: list[str], last: str, name: str) -> DataFrame:
    """One row of each group of ``by``, with the step that chose it: the only row among the first k of all rankings for the least k
    that leaves any (``three``); where several are left, the same by the rankings of ``two`` alone (``two``); else the greatest
    ``last``, of equals the least ``name`` (``one``). Rows of one rank are equally good."""
    here = Window.partitionBy(*by)
    rank = lambda a: F.rank().over(here.orderBy(F.desc_nulls_last(a)))
    ranked = points.select("*", F.greatest(*map(rank, attributes)).cast("bigint").alias("k3"), F.greatest(*map(rank, two)).cast("bigint").alias("k2"))

    def only(k: str) -> Column:
        """Whether the row alone has the least k."""
        return (F.col(k) == F.min(k).over(here)) & (F.first(f"n_{k}").over(here.orderBy(k)) == 1)

    counted = ranked.withColumn("n_k3", F.count(F.lit(1)).over(Window.partitionBy(*by, "k3"))).withColumn("n_k2", F.count(F.lit(1)).over(Window.partitionBy(*by, "k2")))
    told = counted.withColumn("three", only("k3")).withColumn("two", only("k2"))
    step = F.when(F.col("three"), 1).when(F.col("two"), 2).otherwise(3)
    placed = told.withColumn("_step", step).withColumn("_at", F.row_number().over(here.orderBy("_step", F.desc_nulls_last(last), name)))
    steps = F.element_at(F.array(*map(F.lit, ("three", "two", "one"))), F.col("_step")).alias("step")
    return placed.where("_at = 1").select(*points.columns, steps)
