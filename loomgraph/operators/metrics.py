"""Quality of predictions and the training loop's decisions, over any DataFrame of classes or scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def class_counts(predictions: DataFrame, classes: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """c, target, predicted, hit of each class of ``classes`` (c), zero where it never occurs: one pass and one partial
    aggregation, without a join of rows and classes."""
    same = (F.col(truth) == F.col(predicted)).cast("bigint")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col(truth).cast("int").alias("c"), one.alias("target"), none.alias("predicted"), same.alias("hit")),
        F.struct(F.col(predicted).cast("int").alias("c"), none.alias("target"), one.alias("predicted"), none.alias("hit")),
    )
    counts = predictions.select(F.explode(sides).alias("s")).groupBy("s.c").agg(*(F.sum(f"s.{k}").alias(k) for k in ("target", "predicted", "hit")))
    return classes.select(F.col("c").cast("int").alias("c")).join(counts, "c", "left").select("c", *(F.coalesce(k, none).alias(k) for k in ("target", "predicted", "hit")))


def _over(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def per_class(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class, 0 where a denominator is."""
    hit, target, predicted = F.col("hit"), F.col("target"), F.col("predicted")
    return counts.select("c", _over(hit, predicted).alias("p"), _over(hit, target).alias("r"), _over(2 * hit, predicted + target).alias("f"))


def macro(counts: DataFrame, without: int | None = None) -> DataFrame:
    """Means over the classes, all of them in the divisor, or without class ``without``."""
    each = per_class(counts) if without is None else per_class(counts).where(F.col("c") != without)
    return each.agg(*(T.fixed(F.sum(k) / F.count(F.lit(1))).alias(f"macro_{n}") for k, n in (("p", "p"), ("r", "r"), ("f", "f1"))))


def micro(counts: DataFrame, without: int = 0) -> DataFrame:
    """Accuracy over all classes; precision, recall and F1 over those but ``without``."""
    real = F.col("c") != without
    total = lambda k, only: F.sum(F.when(real, F.col(k)).otherwise(0) if only else F.col(k)).cast("double")
    sums = counts.agg(total("hit", False).alias("h"), total("target", False).alias("t"), *(total(k, True).alias(f"{k[0]}0") for k in ("hit", "target", "predicted")))
    return sums.select(
        T.fixed(_over(F.col("h"), F.col("t"))).alias("accuracy"), T.fixed(_over(F.col("h0"), F.col("p0"))).alias("micro_p"),
        T.fixed(_over(F.col("h0"), F.col("t0"))).alias("micro_r"), T.fixed(_over(2 * F.col("h0"), F.col("p0") + F.col("t0"))).alias("micro_f1"),
    )


def early_stopping(scores: DataFrame, run: str, epoch: str, score: str, *, patience: int, delta: float = 0) -> DataFrame:
    """run, epoch, score, best, waited, stopped: the counter starts anew when a score reaches the best so far plus ``delta``,
    which then becomes the best, and training stops once it has come to ``patience``. A run's epochs are few, so each run
    is folded in one value; runs are dealt by key."""
    kept = F.sort_array(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(score).alias("v"))))
    kind = dict(scores.dtypes)[score]

    def step(state: Column, row: Column) -> Column:
        better = state["best"].isNull() | (row["v"] >= state["best"] + F.lit(delta).cast(kind))
        best = F.when(better, row["v"]).otherwise(state["best"])
        waited = F.when(better, F.lit(0)).otherwise(state["waited"] + 1)
        stopped = state["stopped"] | (waited >= patience)
        told = F.struct(row["e"].alias("e"), row["v"].alias("v"), best.alias("best"), waited.alias("waited"), stopped.alias("stopped"))
        return F.struct(best.alias("best"), waited.alias("waited"), stopped.alias("stopped"), F.concat(state["rows"], F.array(told)).alias("rows"))

    epochs = dict(scores.dtypes)[epoch]
    start = F.struct(F.lit(None).cast(kind).alias("best"), F.lit(0).alias("waited"), F.lit(False).alias("stopped"), F.array().cast(f"array<struct<e:{epochs},v:{kind},best:{kind},waited:int,stopped:boolean>>").alias("rows"))
    folded = scores.groupBy(run).agg(F.aggregate(kept, start, step)["rows"].alias("rows"))
    return folded.select(run, F.explode("rows").alias("r")).select(run, F.col("r.e").alias(epoch), F.col("r.v").alias(score), "r.best", F.col("r.waited").cast("bigint").alias("waited"), "r.stopped")


def best_epoch(scores: DataFrame, run: str, epoch: str, score: str) -> DataFrame:
    """The earliest epoch of the greatest score; epoch 0 isn't evaluated."""
    best = F.max(F.struct(F.col(score), (-F.col(epoch)).alias("k"))).alias("b")
    return scores.where(F.col(epoch) > 0).groupBy(run).agg(best).select(run, (-F.col("b.k")).alias(epoch), F.col(f"b.{score}").alias(score))


def row_counts(df: DataFrame, kept: Column) -> DataFrame:
    """Rows before and after a filter."""
    return df.agg(F.count(F.lit(1)).alias("before"), F.count(F.when(kept, 1)).alias("after"))
