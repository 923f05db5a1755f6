"""Ranking, agreement and summary metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .sequences import average_rank


def prefix_sums(df: DataFrame, by: list[str], order: str, sums: list[str], bucket: Column) -> DataFrame:
    """Running sums of ``sums`` (named c_...) by falling ``order``, without a task that sees a whole key.

    ``bucket`` must fall with ``order`` and have a bounded number of values: sums of whole buckets are run over a row
    each, then rows within their bucket.
    """
    df = df.withColumn("_b", bucket)
    totals = df.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    above = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_b").orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, 0)
    own = df.select("*", *[F.sum(c).over(inside).alias(f"c_{c}") for c in sums])
    out = own.join(totals, [*by, "_b"])
    return out.select(*df.drop("_b").columns, *[(F.col(f"c_{c}") + F.col(f"_{c}")).alias(f"c_{c}") for c in sums])


#: Buckets of values are cut at this many squared quantiles of a sketch, once there are so many distinct values.
SKETCH, SKETCHED = 12, 4096


def sketch(value: str) -> Column:
    """An aggregate for ``sketch_bucket``: quantiles of the values of all keys, none where one task can hold all. A key with a share of the rows has at most that many times more of a bucket."""
    cuts = F.percentile_approx(F.col(value).cast("double"), [k / SKETCH**2 for k in range(1, SKETCH**2)], 2_000)
    return F.when(F.count(value) > SKETCHED, cuts).otherwise(F.array().cast("array<double>"))


def sketch_bucket(rough: str, bounds: str, value: str) -> Column:
    """A bucket that rises with ``value``: how many bounds are below it, found among every SKETCH-th (``rough``) and then between two of those. Equal values share one, and no spread of the values makes one large."""
    below = lambda cuts: F.size(F.filter(cuts, lambda b: b < F.col(value)))
    return below(F.col(rough)) * SKETCH + below(F.slice(bounds, below(F.col(rough)) * SKETCH + 1, F.lit(SKETCH)))


def bucketed(df: DataFrame, value: str, buckets: int | None = None) -> DataFrame:
    """``df`` with ``_at``, the bucket of each value; ``buckets`` are so many whatever the number of values."""
    if buckets:
        cuts = df.agg(F.percentile_approx(F.col(value).cast("double"), [k / buckets for k in range(1, buckets)], 2_000).alias("_bounds"))
        return df.crossJoin(F.broadcast(cuts)).withColumn("_at", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")  # one row
    bounds = df.agg(sketch(value).alias("_bounds"))
    bounds = bounds.select("_bounds", F.filter("_bounds", lambda _, i: i % SKETCH == SKETCH - 1).alias("_rough"))
    return df.crossJoin(F.broadcast(bounds)).withColumn("_at", sketch_bucket("_rough", "_bounds", value)).drop("_bounds", "_rough")  # one row


def curve(df: DataFrame, by: list[str], score: str, label: str, buckets: int | None = None) -> DataFrame:
    """A row for each distinct score: tp and fp of keeping rows at or above it, positives and rows of the key."""
    groups = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    run = prefix_sums(bucketed(groups, score, buckets), by, score, ["pos", "n"], F.col("_at"))
    whole = groups.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("n").alias("rows"))
    run = run.join(whole, by) if by else run.crossJoin(F.broadcast(whole))  # one row
    return run.select(*by, score, "pos", "n", F.col("c_pos").alias("tp"), (F.col("c_n") - F.col("c_pos")).alias("fp"), "positives", "rows")


def average_precision(points: DataFrame, by: list[str]) -> DataFrame:
    """From ``curve``: precision at each distinct score weighed by its positives; null without positives."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return points.groupBy(*by).agg(F.when(F.max("positives") > 0, F.sum(precision * ratio(F.col("pos"), F.col("positives")))).alias("ap"))


def auroc(points: DataFrame, by: list[str]) -> DataFrame:
    """From ``curve``: share of (positive, negative) pairs in the right order, ties half; null with one class."""
    neg = F.col("n") - F.col("pos")
    wins = F.sum(neg * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    p, n = F.max("positives"), F.max(F.col("rows") - F.col("positives"))
    return points.groupBy(*by).agg(F.when((p > 0) & (n > 0), wins / (p * n)).alias("auroc"))


def with_rates(points: DataFrame) -> DataFrame:
    tp, fp = F.col("tp"), F.col("fp")
    p, r = ratio(tp, tp + fp), ratio(tp, F.col("positives"))
    return points.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).withColumn("pruned", 1 - (tp + fp) / F.col("rows"))


def best_threshold(points: DataFrame, by: list[str], score: str, recall: float | None = None) -> DataFrame:
    """Threshold of the highest F1 (then recall, then the lower one), or of the most pruning at a recall of at least ``recall`` (then recall, then the higher one)."""
    rated = with_rates(points)
    if recall is None:
        key = F.struct(F.round("f1", 12).alias("a"), "recall", (-F.col(score)).alias("b"))
    else:
        rated, key = rated.where(F.col("recall") >= recall), F.struct(F.round("pruned", 12).alias("a"), "recall", F.col(score).alias("b"))
    best = rated.groupBy(*by).agg(F.max_by(F.struct(score, "precision", "recall", "f1", "pruned"), key).alias("x"))
    return best.select(*by, F.col(f"x.{score}").alias("tau"), "x.precision", "x.recall", "x.f1", "x.pruned")


def average_precision_in_order(df: DataFrame, by: list[str], score: str, tie: str, label: str) -> DataFrame:
    """Average precision of a key's rows in the order (score desc, tie): ties are not grouped. Null without positives."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    hit = F.col(label).cast("bigint")
    ranked = df.select(*by, hit.alias("y"), F.sum(hit).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("tp"), F.row_number().over(w).alias("k"))
    return ranked.groupBy(*by).agg(F.when(F.sum("y") > 0, F.sum(F.col("y") * F.col("tp") / F.col("k")) / F.sum("y")).alias("ap"))


def confusion(df: DataFrame, by: list[str], truth: Column, keep: Column) -> DataFrame:
    """Counts, and ratios that are null where their denominator is 0."""
    n = lambda c: F.count_if(c)
    out = df.groupBy(*by).agg(n(truth & keep).alias("tp"), n(~truth & keep).alias("fp"), n(truth & ~keep).alias("fn"), n(~truth & ~keep).alias("tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select("*", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks; null under two rows or without spread."""
    ranked = df.select(*by, average_rank(x, by).alias("rx"), average_rank(y, by).alias("ry"))
    spread = (F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0)
    return ranked.groupBy(*by).agg(F.when(spread, F.covar_pop("rx", "ry") / (F.stddev_pop("rx") * F.stddev_pop("ry"))).alias("rho"), F.count(F.lit(1)).alias("n"))


def kendall_tau_b(df: DataFrame, by: list[str], x: str, y: str, item: str) -> DataFrame:
    """Tau-b over all pairs of a key: quadratic in a key's rows by definition, so for short keys. Null without spread."""
    other = df.select(*by, F.col(item).alias("_i"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    pairs = df.join(other, by).where(F.col(item) < F.col("_i"))
    a, b = F.signum(F.col(x) - F.col("_x")), F.signum(F.col(y) - F.col("_y"))
    sums = pairs.groupBy(*by).agg(F.sum(a * b).alias("s"), F.sum(F.abs(a)).alias("nx"), F.sum(F.abs(b)).alias("ny"))
    return sums.select(*by, F.when((F.col("nx") > 0) & (F.col("ny") > 0), F.col("s") / F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"))


def ndcg(df: DataFrame, by: list[str], score: str, gain: str, tie: str, fraction: float) -> DataFrame:
    """Discounted gain of the first ceil(fraction * n) rows over the best possible; null where that is 0."""
    every = Window.partitionBy(*by)
    k = F.ceil(F.count(F.lit(1)).over(every) * F.lit(fraction) - 1e-12)
    ranked = df.select(*by, F.col(gain).alias("g"), F.row_number().over(every.orderBy(F.desc(score), tie)).alias("a"), F.row_number().over(every.orderBy(F.desc(gain), tie)).alias("b"), k.alias("k"))
    part = lambda c: F.sum(F.when(F.col(c) <= F.col("k"), F.col("g") / F.log2(F.col(c) + 1)))
    return ranked.groupBy(*by).agg(F.when(part("b") > 0, part("a") / part("b")).alias("ndcg"))


def fleiss(df: DataFrame, by: list[str], yes: str, raters: int) -> DataFrame:
    """Agreement of binary votes (``yes`` of ``raters`` per item): unanimous share, pairwise agreement, kappa (null without spread)."""
    n, y = F.lit(float(raters)), F.col(yes)
    agree = (y * (y - 1) + (n - y) * (n - y - 1)) / (n * (n - 1))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.avg(((y == 0) | (y == raters)).cast("double")).alias("unanimous"), F.avg(agree).alias("pairwise"), (F.sum(y) / (F.count(F.lit(1)) * n)).alias("p"))
    chance = F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p"))
    return out.select(*by, "items", "unanimous", "pairwise", F.when(chance < 1, (F.col("pairwise") - chance) / (1 - chance)).alias("kappa"))


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], between: bool = True, buckets: int | None = None) -> DataFrame:
    """Exact quantiles of each key as columns named by ``shares``: between neighbours by place, or the element min(floor(q * n), n - 1).

    Rows are counted by distinct value; counts are run over buckets that a sketch bounds, then within them, so no task sees a whole key and no outlier makes a bucket large.
    """
    groups = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ends = groups.groupBy(*by).agg(F.sum("_c").alias("_rows"))
    groups = groups.join(ends, by) if by else groups.crossJoin(F.broadcast(ends))  # one row
    run = prefix_sums(bucketed(groups, value, buckets), by, value, ["_c"], F.col("_at"))
    first = F.col("_rows") - F.col("c__c")
    at = lambda place: F.max(F.when((first <= place) & (place < first + F.col("_c")), F.col(value)))
    out = []
    for name, q in shares.items():
        place = (F.col("_rows") - 1) * F.lit(q) if between else F.least(F.floor(F.col("_rows") * F.lit(q)), F.col("_rows") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return run.groupBy(*by).agg(*out)


def field_stats(df: DataFrame, fields: list[str], places: int = 6) -> DataFrame:
    """A row for each field: rows, missing, min, mean, population deviation, median, 95th percentile and distinct rounded values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in fields])).alias("x")).select("x.*")
    long = long.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    plain = long.groupBy("field").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v").isNull()).alias("missing"), F.min("v").alias("low"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.max("v").alias("high"))
    distinct = long.select("field", F.round("v", places).alias("v")).distinct().groupBy("field").agg(F.count("v").alias("distinct"))
    return plain.join(distinct, "field").join(quantiles(long, ["field"], "v", {"median": 0.5, "p95": 0.95}), "field", "left")


def effect_size(df: DataFrame, by: list[str], value: str, positive: Column) -> DataFrame:
    """Difference of means over the pooled sample deviation (Cohen's d); null where that is 0."""
    a, b = F.when(positive, F.col(value)), F.when(~positive, F.col(value))
    out = df.groupBy(*by).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    return out.select(*by, F.when(pooled > 0, (F.col("ma") - F.col("mb")) / pooled).alias("d"))


def retention(df: DataFrame, by: list[str], score: str, tie: str, label: str, percents: list[int]) -> DataFrame:
    """Share of positives kept and of negatives dropped when the best floor(n * percent / 100) rows of a key stay."""
    w = Window.partitionBy(*by)
    ranked = df.select(*by, F.col(label).cast("bigint").alias("y"), F.row_number().over(w.orderBy(F.desc(score), tie)).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    ranked = ranked.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    kept = F.col("k") * 100 <= F.col("n") * F.col("percent")
    y = F.col("y")
    out = ranked.groupBy(*by, "percent").agg(F.sum(F.when(kept, y)).alias("tp"), F.sum(y).alias("pos"), F.sum(F.when(~kept, 1 - y)).alias("dropped"), F.sum(1 - y).alias("neg"))
    return out.select(*by, "percent", ratio(F.coalesce("tp", F.lit(0)), F.col("pos")).alias("kept_positives"), ratio(F.coalesce("dropped", F.lit(0)), F.col("neg")).alias("dropped_negatives"))
