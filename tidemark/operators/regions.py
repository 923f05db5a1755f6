"""Masks of frames to an exact budget: whole regions by their mean score, and random stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(frames: DataFrame, by: list[str], frame: str) -> DataFrame:
    """``frames`` with the run of neighbouring numbers that each is in: `_run` (its first frame), `_len` and `_at` (place from 0)."""
    order = Window.partitionBy(*by).orderBy(frame)
    out = frames.withColumn("_group", F.col(frame) - F.row_number().over(order))
    run = Window.partitionBy(*by, "_group")
    return out.withColumn("_run", F.min(frame).over(run)).withColumn("_len", F.count(F.lit(1)).over(run)).withColumn("_at", F.col(frame) - F.col("_run")).drop("_group")


def centered(frames: DataFrame, by: list[str], frame: str, count: str) -> DataFrame:
    """Of each key, ``count`` frames: the longest runs first, then the earliest; of the last run the middle."""
    own = runs(frames, by, frame)
    each = own.groupBy(*by, "_run", "_len").agg(F.max(count).alias("_count"))
    before = F.coalesce(F.sum("_len").over(Window.partitionBy(*by).orderBy(F.desc("_len"), "_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("_take", F.greatest(F.least(F.col("_count") - before, F.col("_len")), F.lit(0))).select(*by, "_run", "_take")
    out = own.join(each, [*by, "_run"])
    start = F.expr("(_len - _take) div 2")
    return out.where((F.col("_at") >= start) & (F.col("_at") < start + F.col("_take"))).drop("_run", "_len", "_at", "_take")


def region_mask(frames: DataFrame, regions: DataFrame, by: list[str], frame: str, region: str, score: str, tie: str, budget: str) -> DataFrame:
    """Rows (by, frame) of the regions with the lowest mean score, to exactly ``budget`` frames of each key.

    ``frames`` (by, frame, score, tie, budget) are those that may be chosen, ``regions`` (by, region, frame) may overlap and name others too.
    Regions come by mean score, then by the least tie; each gives its frames that none before it gave. The region that is too much for the
    budget gives the middle of its longest runs. Fails for a key whose regions hold less than the budget.

    Each frame goes to the first region that has it, so what a region adds is a count, and where the budget ends a running sum over regions.
    """
    inside = regions.select(*by, region, frame).distinct().join(frames.select(*by, frame, score, tie, budget), [*by, frame])
    units = inside.groupBy(*by, region).agg(F.avg(score).alias("_mean"), F.min(tie).alias("_tie"))
    units = units.withColumn("_order", F.row_number().over(Window.partitionBy(*by).orderBy("_mean", "_tie", region))).select(*by, region, "_order")
    owned = inside.join(units, [*by, region]).groupBy(*by, frame).agg(F.min("_order").alias("_order"), F.max(budget).alias("_budget"))
    sizes = owned.groupBy(*by, "_order").agg(F.count(F.lit(1)).alias("_new"))
    before = F.coalesce(F.sum("_new").over(Window.partitionBy(*by).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).withColumn("_all", F.sum("_new").over(Window.partitionBy(*by)))
    placed = owned.join(sizes, [*by, "_order"])
    short = F.raise_error(F.concat(F.lit("regions hold less than the budget of "), F.to_json(F.struct(*by)))).cast("boolean")
    placed = placed.where(F.when(F.col("_all") < F.col("_budget"), short).otherwise(True))
    whole = placed.where(F.col("_before") + F.col("_new") <= F.col("_budget")).select(*by, frame)
    part = placed.where((F.col("_before") < F.col("_budget")) & (F.col("_before") + F.col("_new") > F.col("_budget"))).withColumn("_left", F.col("_budget") - F.col("_before"))
    return whole.unionByName(centered(part.select(*by, frame, "_left"), by, frame, "_left").select(*by, frame))


def random_interval_mask(frames: DataFrame, by: list[str], frame: str, budget: str, draw: Column) -> DataFrame:
    """Rows (by, frame, exact): a random run of exactly ``budget`` neighbouring frames of each key, each place as likely as the next.

    Where no run of the key is long enough (``exact`` is false) each run gives its share of the budget, rounded by largest remainder, as one
    random stretch. ``draw`` is a number from 0 to 2**32 - 1 of a run's key columns and `_run`; that of `_run` = -1 chooses among the places.
    """
    own = runs(frames.withColumn("_k", F.col(budget)), by, frame)
    each = own.groupBy(*by, "_run", "_len").agg(F.max("_k").alias("_k")).where("_k > 0")
    all_runs, earlier = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_options", F.greatest(F.col("_len") - F.col("_k") + 1, F.lit(0)))
    each = each.withColumn("_total", F.sum("_options").over(all_runs)).withColumn("_before", F.coalesce(F.sum("_options").over(earlier), F.lit(0)))
    whole_draw = each.withColumn("_own", F.col("_run")).withColumn("_run", F.lit(-1).cast("long")).withColumn("_draw", draw).withColumn("_run", F.col("_own")).drop("_own")
    each = whole_draw.withColumn("_pick", F.expr("case when _total > 0 then _draw % _total end") - F.col("_before")).withColumn("_own", draw)
    sizes = F.sum("_len").over(all_runs)
    share = F.col("_k") * F.col("_len")
    each = each.withColumn("_all", sizes).withColumn("_floor", F.expr("(_k * _len) div _all")).withColumn("_rest", share - F.col("_floor") * F.col("_all"))
    rank = F.row_number().over(all_runs.orderBy(F.desc("_rest"), "_run"))
    each = each.withColumn("_quota", F.col("_floor") + (rank <= F.col("_k") - F.sum("_floor").over(all_runs)).cast("long"))
    hit = (F.col("_pick") >= 0) & (F.col("_pick") < F.col("_options"))
    start = F.when(F.col("_total") > 0, F.when(hit, F.col("_pick"))).otherwise(F.expr("_own % (_len - _quota + 1)"))
    length = F.when(F.col("_total") > 0, F.col("_k")).otherwise(F.col("_quota"))
    picks = each.select(*by, "_run", start.alias("_start"), length.alias("_length"), (F.col("_total") > 0).alias("exact")).where("_start is not null and _length > 0")
    out = own.join(picks, [*by, "_run"]).where((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + F.col("_length")))
    return out.select(*by, frame, "exact")
