"""Intervals by resampling whole clusters: multinomial weights that add up to the number of clusters, drawn by hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import bucketed, prefix_sums
from .selection import numbered

#: Clusters that a pair kernel takes at most: it has a cell for each two of them.
CLUSTERS = 2048
#: Cells of a block of distinct scores and clusters in a task.
CELLS = 1 << 21
#: Clusters that bound the buckets in which clusters are numbered, and slots of a draw that are made in one go.
CUTS, SLOTS = 127, 1 << 16


def slot_hash(*parts: Column) -> Column:
    """First 32 bits of the MD5 of the parts joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def numbered_clusters(df: DataFrame, cluster: str, stratum: str | None = None) -> DataFrame:
    """(cluster, stratum, i, n): clusters of each stratum numbered from 0 in order, and how many it has. Buckets between CUTS clusters, those of the least hashes, share the work of a stratum."""
    keys = df.select(cluster, (F.col(stratum) if stratum else F.lit("all")).alias("stratum")).distinct()
    cuts = keys.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.xxhash64(cluster).alias("_h")).orderBy("_h", cluster).limit(CUTS).agg(F.array_sort(F.collect_list(cluster)).alias("_cuts"))
    keys = keys.crossJoin(F.broadcast(cuts))  # one row
    below = F.coalesce(F.size(F.filter("_cuts", lambda x: x <= F.col(cluster))), F.lit(0))
    out = numbered(keys, ["stratum"], [cluster], below, "i", "n")
    return out.select(cluster, "stratum", (F.col("i") - 1).alias("i"), "n")


def slots(sizes: DataFrame, draws: int) -> DataFrame:
    """(stratum, n, draw, slot): as many slots of each draw as a stratum of ``sizes`` (stratum, n) has clusters. They are made in blocks of SLOTS, which are dealt out, so that no task makes those of a whole stratum."""
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = sizes.select("stratum", "n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).select("stratum", "n", "draw", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {SLOTS}"))).alias("_block"))
    last = F.least(F.col("n"), (F.col("_block") + 1) * SLOTS)
    return blocks.repartition(parts, "stratum", "draw", "_block").select("stratum", "n", "draw", F.explode(F.sequence(F.col("_block") * SLOTS + 1, last)).alias("slot"))


def multinomial(clusters: DataFrame, draws: int) -> DataFrame:
    """(stratum, draw, i, w): how often each draw takes cluster i of a stratum. A draw has as many slots as the stratum has clusters; a slot's hash chooses one.

    The weights of a draw add up to the number of clusters; clusters that a draw does not take have no row.
    """
    taken = F.expr("(_h * n) div 4294967296")
    hashed = slots(clusters.groupBy("stratum").agg(F.max("n").alias("n")), draws).withColumn("_h", slot_hash(F.col("stratum"), F.col("draw"), F.col("slot")))
    return hashed.select("stratum", "draw", taken.alias("i")).groupBy("stratum", "draw", "i").agg(F.count(F.lit(1)).alias("w"))


def _ends(samples: DataFrame, value: str, alpha: float) -> DataFrame:
    """Percentile interval of the draws of each stratum; there are as many rows as draws."""
    low, high = (F.percentile(value, q) for q in (alpha / 2, 1 - alpha / 2))
    return samples.groupBy("stratum").agg(low.alias("low"), high.alias("high"))


def ratio_interval(df: DataFrame, cluster: str, numerator: Column, denominator: Column, draws: int = 200, stratum: str | None = None, alpha: float = 0.05) -> DataFrame:
    """(stratum, ratio, low, high) of a ratio of sums over clusters. With 1 as the denominator of each row, it is a mean of rows."""
    named = df.withColumn("stratum", F.col(stratum) if stratum else F.lit("all"))
    sums = named.groupBy(cluster, "stratum").agg(F.sum(numerator).alias("num"), F.sum(denominator).alias("den"))
    clusters = numbered_clusters(named, cluster, "stratum")
    parts = sums.join(clusters, [cluster, "stratum"]).select("stratum", "i", "num", "den")
    drawn = multinomial(clusters, draws).join(parts, ["stratum", "i"])
    samples = drawn.groupBy("stratum", "draw").agg(F.try_divide(F.sum(F.col("w") * F.col("num")), F.sum(F.col("w") * F.col("den"))).alias("x"))
    whole = sums.groupBy("stratum").agg(F.try_divide(F.sum("num"), F.sum("den")).alias("ratio"))
    return whole.join(_ends(samples, "x", alpha), "stratum")


def pair_kernel(df: DataFrame, clusters: DataFrame, cluster: str, score: str, label: str, buckets: int = 16) -> DataFrame:
    """(stratum, i, j, wins): how many pairs of a positive of cluster i and a negative of cluster j have the positive higher, ties half.

    Scores are cut into buckets at quantiles of a sketch. A bucket's task sorts its rows once, with the counts of the negatives of
    all lower buckets as a start, so no pair of rows is made. Fails for a stratum with more than CLUSTERS clusters: the kernel has the square of them.
    """
    many = F.raise_error(F.lit(f"a pair kernel takes at most {CLUSTERS} clusters; use the resampling by score instead")).cast("boolean")
    sound = clusters.where(F.when(F.col("n") > CLUSTERS, many).otherwise(True))
    named = df if "stratum" in df.columns else df.withColumn("stratum", F.lit("all"))
    y = F.col(label).cast("bigint")
    rows = named.where(F.col(score).isNotNull()).join(sound, [cluster, "stratum"]).groupBy("stratum", "n", "i", F.col(score).cast("double").alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    bounds = rows.groupBy("stratum").agg(F.array_distinct(F.percentile_approx("s", [k / buckets for k in range(1, buckets)], 10_000)).alias("_bounds"))
    rows = rows.join(bounds, "stratum").withColumn("b", F.size(F.filter("_bounds", lambda x: x < F.col("s")))).drop("_bounds")
    below = rows.groupBy("stratum", "n", "i", "b").agg(F.sum("neg").alias("neg")).where("neg > 0")
    starts = below.select("stratum", "n", "i", "neg", F.explode(F.sequence(F.col("b") + 1, F.lit(buckets))).alias("b")).groupBy("stratum", "n", "i", "b").agg(F.sum("neg").alias("neg"))
    starts = starts.join(rows.select("stratum", "b").distinct(), ["stratum", "b"], "left_semi")
    both = rows.unionByName(starts.withColumn("s", F.lit(None).cast("double")).withColumn("pos", F.lit(0).cast("bigint")))

    def wins(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        stratum, n = key[0], int(part["n"].iloc[0])
        start = part[part["s"].isna()]
        lower = np.zeros(n)
        np.add.at(lower, start["i"].to_numpy(), start["neg"].to_numpy(float))
        part = part[part["s"].notna()].sort_values("s", kind="stable")
        _, place = np.unique(part["s"].to_numpy(), return_inverse=True)
        i, pos, neg = part["i"].to_numpy(), part["pos"].to_numpy(float), part["neg"].to_numpy(float)
        out, step = np.zeros((n, n)), max(1, CELLS // n)
        for low in range(0, int(place.max(initial=-1)) + 1, step):
            own = (place >= low) & (place < low + step)
            size = min(step, int(place.max()) + 1 - low)
            p, q = np.zeros((size, n)), np.zeros((size, n))
            np.add.at(p, (place[own] - low, i[own]), pos[own])
            np.add.at(q, (place[own] - low, i[own]), neg[own])
            upto = lower + np.cumsum(q, axis=0)
            out += p.T @ (upto - q / 2)
            lower = upto[-1]
        a, b = np.nonzero(out)
        return pd.DataFrame({"stratum": stratum, "i": a.astype(np.int64), "j": b.astype(np.int64), "wins": out[a, b]})

    parts = both.groupBy("stratum", "b").applyInPandas(wins, "stratum string, i long, j long, wins double")
    return parts.groupBy("stratum", "i", "j").agg(F.sum("wins").alias("wins"))


def auc_interval(df: DataFrame, cluster: str, score: str, label: str, draws: int = 200, stratum: str | None = None, alpha: float = 0.05, kernel: DataFrame | None = None) -> DataFrame:
    """(stratum, auc, low, high) of the pooled AUROC with clusters drawn whole, from the pair kernel; null where a draw, or all, lack a class.

    A draw's pairs are the kernel weighed by the weights of both clusters. Kernel cells meet the weights as arrays, one for each cluster.
    """
    named = df.withColumn("stratum", (F.col(stratum) if stratum else F.lit("all")).cast("string"))
    clusters = numbered_clusters(named, cluster, "stratum")
    kernel = pair_kernel(named, clusters, cluster, score, label) if kernel is None else kernel
    y = F.col(label).cast("bigint")
    sizes = named.where(F.col(score).isNotNull()).groupBy(cluster, "stratum").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")).join(clusters, [cluster, "stratum"])
    weights = multinomial(clusters, draws)
    lines = weights.groupBy("stratum", "i").agg(F.map_from_entries(F.collect_list(F.struct(F.col("draw").cast("int"), F.col("w").cast("double")))).alias("m"))
    lines = lines.select("stratum", "i", F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda d: F.coalesce(F.col("m")[d], F.lit(0.0))).alias("w"))
    cells = kernel.join(lines, ["stratum", "i"]).join(lines.select("stratum", F.col("i").alias("j"), F.col("w").alias("v")), ["stratum", "j"]).select("stratum", "wins", "w", "v")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            w, v = (batch.column(c).flatten().to_numpy().reshape(-1, draws) for c in ("w", "v"))
            each, names = w * v * batch.column("wins").to_numpy()[:, None], np.array(batch.column("stratum").to_pylist(), object)
            for name in set(names):
                sums[name] = sums.get(name, 0) + each[names == name].sum(axis=0)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * draws), pa.array(np.arange(1, draws + 1)), pa.array(total)], ["stratum", "draw", "wins"])

    won = cells.mapInArrow(add, "stratum string, draw long, wins double").groupBy("stratum", "draw").agg(F.sum("wins").alias("wins"))
    classes = weights.join(sizes.select("stratum", "i", "pos", "neg"), ["stratum", "i"]).groupBy("stratum", "draw").agg(F.sum(F.col("w") * F.col("pos")).alias("pos"), F.sum(F.col("w") * F.col("neg")).alias("neg"))
    pairs = F.col("pos").cast("double") * F.col("neg")
    samples = classes.join(won, ["stratum", "draw"], "left").select("stratum", F.when(pairs > 0, F.coalesce("wins", F.lit(0.0)) / pairs).alias("x"))
    all_pairs = sizes.groupBy("stratum").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    whole = all_pairs.join(kernel.groupBy("stratum").agg(F.sum("wins").alias("wins")), "stratum", "left").select("stratum", F.when(pairs > 0, F.coalesce("wins", F.lit(0.0)) / pairs).alias("auc"))
    return whole.join(_ends(samples, "x", alpha), "stratum")


def auc_interval_by_score(df: DataFrame, cluster: str, score: str, label: str, draws: int = 200, stratum: str | None = None, alpha: float = 0.05) -> DataFrame:
    """The result of ``auc_interval`` for any number of clusters: weights meet the rows, which are counted by draw and distinct score, so work grows with rows x draws.

    Counts are run over buckets of scores that a sketch bounds, then within them: no task sees a whole draw, and rows of a crowded score are summed before the shuffle.
    """
    named = df.withColumn("stratum", (F.col(stratum) if stratum else F.lit("all")).cast("string"))
    clusters = numbered_clusters(named, cluster, "stratum")
    lists = multinomial(clusters, draws).groupBy("stratum", "i").agg(F.collect_list(F.struct(F.col("draw").cast("int").alias("draw"), "w")).alias("_w"))
    # the draw 0 is the sample itself
    itself = F.array(F.struct(F.lit(0).alias("draw"), F.lit(1).cast("bigint").alias("w")))
    weights = clusters.join(lists, ["stratum", "i"], "left").select(cluster, "stratum", F.when(F.col("_w").isNull(), itself).otherwise(F.concat(itself, "_w")).alias("_w"))
    y = F.col(label).cast("bigint")
    rows = named.where(F.col(score).isNotNull()).groupBy(cluster, "stratum", F.col(score).cast("double").alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    drawn = bucketed(rows, "s").join(weights, [cluster, "stratum"]).select("stratum", "_at", "s", "pos", "neg", F.explode("_w").alias("_w"))
    counts = drawn.groupBy("stratum", F.col("_w.draw").alias("draw"), "_at", "s").agg(*[F.sum(F.col("_w.w") * F.col(c)).alias(c) for c in ("pos", "neg")])
    run = prefix_sums(counts, ["stratum", "draw"], "s", ["pos"], F.col("_at"))
    double = lambda c: F.col(c).cast("double")
    wins, pairs = F.sum(double("neg") * (double("c_pos") - double("pos") / 2)), F.sum("pos").cast("double") * F.sum("neg")
    samples = run.groupBy("stratum", "draw").agg(F.when(pairs > 0, wins / pairs).alias("x"))
    low, high = (F.percentile(F.when(F.col("draw") > 0, F.col("x")), q) for q in (alpha / 2, 1 - alpha / 2))
    return samples.groupBy("stratum").agg(F.max(F.when(F.col("draw") == 0, F.col("x"))).alias("auc"), low.alias("low"), high.alias("high"))
