"""Evaluation metrics: one aggregation to counts per class, then arithmetic on as many rows as classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(predicted: DataFrame) -> DataFrame:
    """(truelabel, label, n)."""
    return predicted.groupBy("truelabel", "label").agg(F.count("*").alias("n"))


def _per_class(predicted: DataFrame) -> DataFrame:
    """(c, size, hit, claimed, all): samples of the class, right ones, ones labelled as it, and all samples."""
    ends = predicted.select(F.explode(F.array(F.struct(F.col("truelabel").alias("c"), F.lit(1).alias("own"), (F.col("truelabel") == F.col("label")).cast("int").alias("hit")), F.struct(F.col("label").alias("c"), F.lit(0).alias("own"), F.lit(0).alias("hit")))).alias("e"))
    got = ends.groupBy("e.c").agg(F.sum("e.own").alias("size"), F.sum("e.hit").alias("hit"), F.sum(1 - F.col("e.own")).alias("claimed"))
    return got.withColumn("all", F.sum("size").over(W.partitionBy()))


def true_positives(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.avg((F.col("truelabel") == F.col("label")).cast("double")).alias("accuracy"))


def f_score(predicted: DataFrame) -> DataFrame:
    """The mean over classes of 2 P R / (P + R); a class without right samples counts as 0."""
    f = 2 * F.col("hit") / (F.col("size") + F.col("claimed"))
    return _per_class(predicted).agg(F.avg(f).alias("f_score"))


def normalised_accuracy(predicted: DataFrame) -> DataFrame:
    """The mean of the classes' shares of right samples."""
    return _per_class(predicted).agg(F.avg(F.when(F.col("size") > 0, F.col("hit") / F.col("size")).otherwise(0.0)).alias("accuracy"))


def skewed_true_positives(predicted: DataFrame) -> DataFrame:
    """Right shares weighted by 1 - the class's share."""
    w = 1 - F.col("size") / F.col("all")
    return _per_class(predicted).where("size > 0").agg((F.sum(F.col("hit") / F.col("size") * w) / F.sum(w)).alias("accuracy"))


def weighted_accuracy(predicted: DataFrame) -> DataFrame:
    """1 - the larger one of the mean miss and the mean false-alarm rate."""
    miss, alarm = _rates()
    return _per_class(predicted).agg((1 - F.greatest(F.avg(miss), F.avg(alarm))).alias("accuracy"))


def optimum_path_accuracy(predicted: DataFrame) -> DataFrame:
    """1 - the sum of both rates over classes that occur, by twice their number."""
    miss, alarm = _rates()
    return _per_class(predicted).where("size > 0").agg((1 - F.sum(miss + alarm) / (2 * F.count("*"))).alias("accuracy"))


def _rates() -> tuple[Column, Column]:
    size, hit, claimed, total = (F.col(c) for c in ("size", "hit", "claimed", "all"))
    miss = F.when(size > 0, (size - hit) / size).otherwise(0.0)
    alarm = F.when(total > size, (claimed - hit) / (total - size)).otherwise(0.0)
    return miss, alarm


def kappa(predicted: DataFrame) -> DataFrame:
    p = _per_class(predicted)
    a = F.col("all")
    parts = p.agg((F.sum("hit") / F.max(a)).alias("o"), F.sum(F.col("size") / a * F.col("claimed") / a).alias("e"))
    return parts.select(((F.col("o") - F.col("e")) / (1 - F.col("e") + 1e-7)).alias("kappa"))


def binary(rows: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """Counts and all two-class measures of 0/1 columns: precision, recall, f beta, Dice, Matthews, false accepts and rejects."""
    one = lambda c: F.sum(c.cast("double"))
    t, g = truth == 1, guess == 1
    c = rows.where(truth.isNotNull() & guess.isNotNull()).agg(one(t & g).alias("tp"), one(~t & g).alias("fp"), one(t & ~g).alias("fn"), one(~t & ~g).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    b2 = 4.0
    return c.select(
        "tp", "fp", "fn", "tn",
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp).alias("f2"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("dice"),
        F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
        F.try_divide(fp, fp + tn).alias("far"), F.try_divide(fn, tp + fn).alias("frr"),
    )


def entropies(joint: DataFrame, a: str, b: str, n: str = "n") -> DataFrame:
    """(ha, hb, hab, nmi) of a table of joint counts: -sum p ln p, and (ha + hb) / (2 hab)."""

    def h(df: DataFrame, name: str) -> DataFrame:
        p = F.col(n) / F.sum(n).over(W.partitionBy())
        return df.select((p * F.log(p)).alias("t")).agg((-F.sum("t")).alias(name))

    ha = h(joint.groupBy(a).agg(F.sum(n).alias(n)), "ha")
    hb = h(joint.groupBy(b).agg(F.sum(n).alias(n)), "hb")
    hab = h(joint.groupBy(a, b).agg(F.sum(n).alias(n)), "hab")
    return ha.crossJoin(hb).crossJoin(hab).withColumn("nmi", (F.col("ha") + F.col("hb")) / (2 * F.col("hab")))


def achievable_accuracy(overlap: DataFrame) -> DataFrame:
    """Of (region, object, n): the share of the largest overlaps."""
    per = overlap.groupBy("region").agg(F.max("n").alias("top"), F.sum("n").alias("size"))
    return per.agg((F.sum("top") / F.sum("size")).alias("asa"))


def under_segmentation(overlap: DataFrame) -> DataFrame:
    """Of (region, object, n): sum of min(inside, outside) by all."""
    size = F.sum("n").over(W.partitionBy("region"))
    return overlap.withColumn("size", size).agg((F.sum(F.least("n", F.col("size") - F.col("n"))) / F.sum("n")).alias("error"))
