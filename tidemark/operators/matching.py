"""Set matching between tables: exact matches, comparisons of two arms, integrity gates, conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import corners, iou
from ..functions.intervals import precision_recall


def frame_match(pred: DataFrame, ref: DataFrame, by: list[str], frame: str) -> DataFrame:
    """Boxes (x, y, w, h) of one key and frame are matched exactly; a frame of one side only has no match, however near another is.

    Precision and recall are the summed IoU over the frames of either side. Both sides empty cannot appear here: a key has a frame.
    """
    b = ref.select(*by, frame, *[F.col(c).alias(f"{c}2") for c in "xywh"])
    both = pred.join(b, [*by, frame], "full_outer")
    value = F.when(F.col("x").isNotNull() & F.col("x2").isNotNull(), iou(corners(*(F.col(c) for c in "xywh")), corners(*(F.col(f"{c}2") for c in "xywh"))))
    out = both.groupBy(*by).agg(F.count("x").alias("predicted"), F.count("x2").alias("reference"), F.count(value).alias("common"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    p, r, f, _ = precision_recall(F.col("total"), F.col("predicted"), F.col("reference"))
    return out.select(*by, "predicted", "reference", "common", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def set_metrics(pred: DataFrame, ref: DataFrame, by: list[str], item: str) -> DataFrame:
    """Precision, recall and F1 of distinct items by key, 0.0 on empty sides."""
    a, b = pred.select(*by, item).distinct().withColumn("p", F.lit(1)), ref.select(*by, item).distinct().withColumn("r", F.lit(1))
    out = a.join(b, [*by, item], "full_outer").groupBy(*by).agg(F.count("p").alias("predicted"), F.count("r").alias("reference"), F.count_if(F.col("p").isNotNull() & F.col("r").isNotNull()).alias("common"))
    part = lambda n: F.when(n > 0, F.col("common") / n).otherwise(0.0)
    p, r = part(F.col("predicted")), part(F.col("reference"))
    return out.select("*", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def macro_micro(videos: DataFrame) -> DataFrame:
    """One row: means of the per-key ratios of ``set_metrics`` and the ratios of the pooled counts."""
    s = lambda c: F.sum(c)
    return videos.agg(
        F.count(F.lit(1)).alias("keys"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        F.when(s("predicted") > 0, s("common") / s("predicted")).otherwise(0.0).alias("micro_precision"), F.when(s("reference") > 0, s("common") / s("reference")).otherwise(0.0).alias("micro_recall"),
    )


def compare_arms(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], by: list[str]) -> DataFrame:
    """Two runs matched on ``keys``: rows of one side only, equal rows, and the mean absolute difference of each value."""
    right = b.select(*keys, *[F.col(c).alias(f"{c}2") for c in values], F.lit(1).alias("_r"))
    both = a.withColumn("_l", F.lit(1)).join(right, keys, "full_outer")
    met = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    equal = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in values])
    return both.groupBy(*by).agg(
        F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"), F.count_if(met & equal).alias("equal"), F.count_if(met).alias("matched"),
        *[F.avg(F.when(met, F.abs(F.col(c) - F.col(f"{c}2")))).alias(f"mean_{c}") for c in values],
    )


def paired(a: DataFrame, b: DataFrame, key: str, value: str, tie: float) -> DataFrame:
    """One row: how often ``b`` wins, ties (difference up to ``tie``) and loses against ``a`` on shared keys, and the mean difference."""
    both = a.select(key, F.col(value).alias("va")).join(b.select(key, F.col(value).alias("vb")), key)
    d = F.col("vb") - F.col("va")
    return both.agg(F.count_if(d > tie).alias("wins"), F.count_if(F.abs(d) <= tie).alias("ties"), F.count_if(d < -tie).alias("losses"), F.avg(d).alias("mean_delta"))


def integrity(expected: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """One row: expected keys that are missing, keys that were not expected, keys produced more than once, and whether all are 0."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    p = produced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = e.join(p, keys, "full_outer").agg(F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("extra"), F.count_if(F.col("_n") > 1).alias("duplicate"))
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("duplicate") == 0))


def contenders(boxes: DataFrame, key: str, gap: float, far: float) -> DataFrame:
    """Per key: boxes other than the best (score, area, then least ordinal) within ``gap`` of its score and with an IoU below ``far``."""
    best = F.max(F.struct("score", (F.col("w") * F.col("h")).alias("a"), (-F.col("ordinal")).alias("o"), "x", "y", "w", "h")).over(Window.partitionBy(key))
    both = boxes.withColumn("b", best)
    near = (F.col("ordinal") != -F.col("b.o")) & (F.col("b.score") - F.col("score") <= gap) & (iou(corners(*(F.col(c) for c in "xywh")), corners(*(F.col(f"b.{c}") for c in "xywh"))) < far)
    return both.groupBy(key).agg(F.first(-F.col("b.o")).alias("best"), F.count_if(near).alias("contenders"))


def unpivot(df: DataFrame, columns: list[str], name: str = "key") -> DataFrame:
    """Distinct non-null values of several id columns."""
    return df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias(name)).where(F.col(name).isNotNull()).distinct()


def gate(row: DataFrame, rules: list[tuple[str, str, str, float]]) -> DataFrame:
    """One row of measures against named rules (name, measure, 'min' or 'max', bound): a row per rule; a null measure fails."""
    checks = []
    for name, measure, kind, bound in rules:
        v = F.col(measure).cast("double")
        checks.append(F.struct(F.lit(name).alias("rule"), v.alias("value"), F.lit(float(bound)).alias("bound"), F.coalesce(v >= bound if kind == "min" else v <= bound, F.lit(False)).alias("passed")))
    return row.select(F.explode(F.array(*checks)).alias("x")).select("x.*")


def verdict(*cases: tuple[Column, str], otherwise: str) -> Column:
    """First case that holds; a null condition does not."""
    out = None
    for condition, name in cases:
        c = F.coalesce(condition, F.lit(False))
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(otherwise)
