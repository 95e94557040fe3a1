"""Rule inference and node importance by joins that repeat until nothing is new; every round is written to the shared
folder, so lineage stays short and lost executors cost one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sinks.workspace import shared_folder


def _cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(a, b) reachable by one or more edges, without loops. Where no node has two successors or two predecessors, nodes are ranked
    along their path and the pairs follow from the ranks; else pairs are joined until nothing is new."""
    steps = _cut(edges.select("a", "b").where("a <> b").distinct())
    if all(steps.groupBy(c).count().where("count > 1").isEmpty() for c in ("a", "b")):
        return _along_paths(steps, rounds)
    return _joined_up(steps, rounds)


def _joined_up(steps: DataFrame, rounds: int) -> DataFrame:
    """Path lengths double a round: pairs at a distance of 2^k exactly are extended by those of up to 2^k, so that each pair is
    formed only once for each node at that place of its shortest paths."""
    known, exact = steps, steps
    after = lambda df: df.select(F.col("a").alias("b"), F.col("b").alias("c"))
    for _ in range(rounds):
        longer = exact.join(after(known), "b").select("a", F.col("c").alias("b")).where("a <> b").distinct()
        new = _cut(longer.join(known, ["a", "b"], "left_anti"))
        if new.isEmpty():
            break
        exact = _cut(exact.join(after(exact), "b").select("a", F.col("c").alias("b")).distinct().join(new, ["a", "b"], "left_semi"))
        known = _cut(known.unionByName(new))
    return known


def _along_paths(steps: DataFrame, rounds: int) -> DataFrame:
    """Every path is walked back in doubling steps: a node learns the first node of its path and its own place; on a cycle, which
    has no first node, the least one. Only nodes move, the pairs are formed as they are returned."""
    nodes = steps.select(F.col("a").alias("v")).unionByName(steps.select(F.col("b").alias("v"))).distinct()
    start = nodes.join(steps.select(F.col("b").alias("v"), F.col("a").alias("up")), "v", "left")
    # up: the node ``far`` steps back, null where the path has begun; root: of all nodes from there on the first, or the least so far
    state = _cut(start.select("v", "up", F.coalesce("up", "v").alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("far"), F.least("v", "up").alias("least"), F.lit(True).alias("moved")))
    before = -1
    for _ in range(rounds):
        left, moved = state.where("up is not null").agg(F.count(F.lit(1)), F.count_if("moved")).first()
        if not left or (left == before and not moved):
            break  # all paths have begun; or only cycles are left and their least nodes don't change
        before = left
        back = state.select(F.col("v").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("far").alias("_far"), F.col("least").alias("_least"))
        going = state.where("up is not null").join(back, "up").select("v", F.col("_up").alias("up"), F.col("_root").alias("root"), (F.col("far") + F.col("_far")).alias("far"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("moved"))
        state = _cut(state.where("up is null").unionByName(going))
    cycle = F.col("up").isNotNull()
    parts = max(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-state.count() // 10_000))
    placed = state.select(F.when(cycle, F.col("least")).otherwise(F.col("root")).alias("path"), cycle.alias("cycle"), F.col("far"), F.col("v")).repartition(parts, "path")
    ends = placed.select("path", F.col("far").alias("_far"), F.col("v").alias("b"))
    later = F.when(F.col("cycle"), F.col("v") != F.col("b")).otherwise(F.col("far") < F.col("_far"))
    return placed.join(ends.hint("merge"), "path").where(later).select(F.col("v").alias("a"), "b")


def one_hop(edges: DataFrame) -> DataFrame:
    two = edges.join(edges.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).where("a <> b").distinct()
    return two.join(edges, ["a", "b"], "left_anti")


def spouses(mothers: DataFrame, fathers: DataFrame, known: DataFrame) -> DataFrame:
    """(b, c) where one child has the mother b and the father c, unless known."""
    both = mothers.join(fathers, "child").select("b", "c").where("b <> c").distinct()
    return both.join(known, ["b", "c"], "left_anti")


def pagerank(edges: DataFrame, rounds: int = 5, damping: float = 0.85) -> DataFrame:
    """(node, rank) of an undirected graph (a, b), ranks summing to 1."""
    both = _cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degree = _cut(both.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    nodes = degree.count()
    rank = degree.select(F.col("a").alias("node"), F.lit(1.0 / max(nodes, 1)).alias("rank"))
    for _ in range(rounds):
        sent = both.join(degree.join(rank.withColumnRenamed("node", "a"), "a").select("a", (F.col("rank") / F.col("n")).alias("share")), "a")
        rank = _cut(sent.groupBy(F.col("b").alias("node")).agg((F.lit((1 - damping) / max(nodes, 1)) + damping * F.sum("share")).alias("rank")))
    return rank


def induced(edges: DataFrame, vertices: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The edges both of whose ends are among ``vertices`` (v)."""
    ends = vertices.select("v").distinct()
    return edges.join(ends.withColumnRenamed("v", a), a, "left_semi").join(ends.withColumnRenamed("v", b), b, "left_semi").select(*edges.columns)
