"""Deterministic samples, splits and quotas, score selectors, and exact budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_key

#: Keys x items x budget of a table of knapsacks.
KNAPSACK_CELLS = 1 << 23


def numbered(df: DataFrame, by: list[str], order: list[str], bucket: Column, name: str = "place", count: str | None = None) -> DataFrame:
    """Numbers the rows of each key by ``order`` from 1, without a task that sees a whole key; ``count`` names a column of the key's rows.

    ``bucket`` must rise with ``order``: rows are numbered within a bucket of their key, after the rows of the buckets before it.
    """
    df = df.withColumn("_b", bucket)
    every = Window.partitionBy(*by)
    sizes = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(every.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(c).alias(f"_{c}_") for c in [*by, "_b"]], before.alias("_before"), F.sum("_n").over(every).alias("_of"))
    own = df.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)))
    both = own.join(sizes, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in [*by, "_b"]])
    return both.select(*df.drop("_b").columns, (F.col("_i") + F.col("_before")).alias(name), *([F.col("_of").alias(count)] if count else []))


def hash_order(df: DataFrame, by: list[str], *key: Column, name: str = "place", count: str | None = None) -> DataFrame:
    """Numbers the rows of each stratum in the order of their hash keys, from 1; 4,096 buckets of keys share the work of a stratum."""
    return numbered(df.withColumn("_h", hash_key(*key)), by, ["_h"], F.substring("_h", 1, 3), name, count).drop("_h")


def hash_split(df: DataFrame, by: list[str], *key: Column, parts: tuple[tuple[str, int], ...] = (("TRAIN", 70), ("CALIBRATION", 15), ("VALIDATION", 15))) -> DataFrame:
    """Exact split of each stratum in hash order: the last part takes what the floors of the others leave to the first."""
    out = hash_order(df, by, *key, count="_n")
    small = [F.floor(F.col("_n") * p / 100) for _, p in parts[1:]]
    first = F.col("_n") - sum(small[1:], small[0])
    ends, label = first, F.when(F.col("place") <= first, parts[0][0])
    for (name, _), size in zip(parts[1:], small, strict=True):
        ends = ends + size
        label = label.when(F.col("place") <= ends, name)
    return out.withColumn("split", label).drop("_n")


def quota(df: DataFrame, by: list[str], most: int, *key: Column) -> DataFrame:
    """The first ``most`` rows of each stratum in hash order."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy("_h"))  # Spark cuts strata to ``most`` rows before the shuffle
    return df.withColumn("_h", hash_key(*key)).withColumn("place", first).where(F.col("place") <= most).drop("_h")


def round_robin(df: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    """Rows dealt one from each category in turn until ``limit``: a top-k, kept as one."""
    dealt = df.withColumn("round", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("round") <= limit)
    return dealt.orderBy("round", by).limit(limit)


def pick_even(df: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """``k`` rows of each key evenly spaced in order: the places floor(i * n / k)."""
    w = Window.partitionBy(*by)
    placed = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * F.col("_n") / k))
    return placed.where(F.array_contains(wanted.cast("array<bigint>"), F.col("_i").cast("bigint"))).drop("_i", "_n")


def selected(df: DataFrame, by: list[str], rule: str, score: str = "score", text: str = "reason", tau: float = 0.5, delta: float = 0.1, deny: str = "", allow: str = "") -> Column:
    """Whether a candidate stays: 'all'; 'threshold' score >= tau; 'relative' within delta of the key's best; 'text' not denied, or allowed."""
    if rule == "all":
        return F.lit(True)
    if rule == "threshold":
        return F.col(score) >= tau
    if rule == "relative":
        return F.col(score) >= F.max(score).over(Window.partitionBy(*by)) - delta
    if rule == "text":
        return ~F.coalesce(F.col(text).rlike(deny), F.lit(False)) | F.coalesce(F.col(text).rlike(allow), F.lit(False))
    raise ValueError(f"no rule {rule}")


def with_margin(df: DataFrame, by: list[str], score: str, floor: float) -> DataFrame:
    """Best score of a key, its second (``floor`` at least), and the difference. Two rows per key leave a task."""
    top = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score)))).where("_k <= 2")
    out = top.groupBy(*by).agg(F.max(score).alias("first"), F.max(F.when(F.col("_k") == 2, F.col(score))).alias("second"))
    second = F.greatest(F.coalesce("second", F.lit(floor)), F.lit(floor))
    return out.select(*by, "first", second.alias("second"), (F.col("first") - second).alias("margin"))


def knapsack(weights: np.ndarray, values: np.ndarray, budget: int) -> list[int]:
    """Exact choice of items of the largest value within the budget; an item is left out where that costs nothing."""
    best = np.zeros((len(weights) + 1, budget + 1))
    for i, (w, v) in enumerate(zip(weights, values, strict=True)):
        best[i + 1] = best[i]
        if w <= budget:
            best[i + 1, w:] = np.maximum(best[i, w:], best[i, : budget + 1 - w] + v)
    out, room = [], budget
    for i in range(len(weights), 0, -1):
        if best[i, room] != best[i - 1, room]:
            out.append(i - 1)
            room -= int(weights[i - 1])
    return out[::-1]


def _by_key(df: DataFrame, key: str, columns: list[str], pick, out: str) -> DataFrame:
    """One row for each key with its ordered rows, from which ``pick`` takes places; rows (key, out). Keys come in Arrow batches, not one by one."""
    kinds = dict(df.dtypes)
    packed = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for k, rows in zip(batch.column(key), batch.column("rows"), strict=True):
                items = rows.values
                places = pick(*[items.field(c) for c in columns])
                keys += [k.as_py()] * len(places)
                found.append(items.field(out).take(pa.array(places, pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), pa.concat_arrays(found) if found else pa.array([], pa.int64())], [key, out])

    return packed.mapInArrow(run, f"{key} {kinds[key]}, {out} {kinds[out]}")


def knapsacks(weights: np.ndarray, values: np.ndarray, budgets: np.ndarray) -> np.ndarray:
    """Which items of each row are chosen, as ``knapsack`` does, for all rows at once: a table of rows x budgets for each item. Padding weighs more than any budget."""
    rows, items = weights.shape
    room = np.arange(int(budgets.max(initial=0)) + 1)
    best, better = np.zeros((rows, len(room))), np.zeros((items, rows, len(room)), bool)
    for i in range(items):
        at = room[None, :] - weights[:, i, None]
        taken = np.take_along_axis(best, np.maximum(at, 0), axis=1) + values[:, i, None]
        better[i] = (at >= 0) & (taken > best)
        best = np.where(better[i], taken, best)
    chosen, left, every = np.zeros((rows, items), bool), budgets.copy(), np.arange(rows)
    for i in range(items - 1, -1, -1):
        chosen[:, i] = better[i, every, left]
        left -= np.where(chosen[:, i], weights[:, i], 0)
    return chosen


def within_budget(df: DataFrame, key: str, item: str, weight: str, value: str, percent: int | None = None, budget: str | None = None) -> DataFrame:
    """(key, item) chosen by an exact knapsack per key within floor(total weight * percent / 100), or within the key's ``budget``. A key's items must fit a task.

    The keys of an Arrow batch are padded into tables of at most KNAPSACK_CELLS keys x items x budget, keys of about the same size together.
    """
    kinds = dict(df.dtypes)
    room = F.max(budget).cast("long") if budget else F.floor(F.sum(weight) * percent / 100).cast("long")
    packed = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(item, F.col(weight).cast("long").alias("_w"), F.col(value).cast("double").alias("_v")))).alias("rows"), room.alias("_room"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("rows")
            sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
            items = rows.flatten()
            starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            w, v = items.field("_w").to_numpy(zero_copy_only=False), items.field("_v").to_numpy(zero_copy_only=False)
            budgets = np.maximum(batch.column("_room").to_numpy(zero_copy_only=False), 0)
            order, kept, at = np.lexsort((budgets, sizes)), np.zeros(len(items), bool), 0
            while at < len(order):
                end, most = at, 0
                while end < len(order):
                    most = max(most, int(budgets[order[end]]))
                    if end > at and (end - at + 1) * int(sizes[order[end]]) * (most + 1) > KNAPSACK_CELLS:
                        break
                    end += 1
                own = order[at:end]
                width = int(sizes[own].max())
                inside = np.arange(width)[None, :] < sizes[own][:, None]
                place = np.where(inside, starts[own][:, None] + np.arange(width)[None, :], 0)
                chosen = knapsacks(np.where(inside, w[place], most + 1), np.where(inside, v[place], 0.0), budgets[own].astype(np.int64))
                kept[place[chosen & inside]] = True
                at = end
            key_of = np.repeat(np.arange(len(sizes)), sizes)[kept]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(key_of)), items.field(item).filter(pa.array(kept))], [key, item])

    return packed.mapInArrow(run, f"{key} {kinds[key]}, {item} {kinds[item]}")


def change_points(x: np.ndarray, most: int, penalty: float = 1.0) -> list[int]:
    """Starts of new segments of a sequence of vectors: least within-segment scatter plus a penalty for each change."""
    n = len(x)
    gram = x @ x.T
    run, diagonal = np.zeros((n + 1, n + 1)), np.concatenate(([0.0], np.cumsum(np.diag(gram))))
    run[1:, 1:] = gram.cumsum(0).cumsum(1)
    at = np.arange(n + 1)
    size = np.maximum(at[None, :] - at[:, None], 1)
    scatter = diagonal[None, :] - diagonal[:, None] - (run[at, at][None, :] - run - run.T + run[at, at][:, None]) / size
    scatter[at[:, None] >= at[None, :]] = np.inf
    cost, back = [scatter[0]], [np.zeros(n + 1, int)]
    for _ in range(min(most, n - 1)):
        total = cost[-1][:, None] + scatter
        back.append(total.argmin(axis=0))
        cost.append(total.min(axis=0))
    ends = np.array([c[n] for c in cost])
    m = np.arange(len(ends))
    extra = np.where(m > 0, penalty * m / (2.0 * n) * (np.log(n / np.maximum(m, 1)) + 1), 0.0)
    k, out, end = int((ends / n + extra).argmin()), [], n
    while k > 0:
        end = int(back[k][end])
        out.append(end)
        k -= 1
    return out[::-1]


def segmented(df: DataFrame, key: str, order: str, vector: str, most: int, penalty: float = 1.0) -> DataFrame:
    """(key, order) of the rows that begin a new segment of each key's sequence of vectors. A key's rows must fit a task."""
    return _by_key(df, key, [order, vector], lambda _, v: change_points(np.array(v.to_pylist(), float), most, penalty), order)


def shots(df: DataFrame, key: str, order: str, vector: str, score: str, frame: str, frames: str, most: int, penalty: float = 1.0) -> DataFrame:
    """The shots of each key's samples: (key, shot, first, end, length, score), between change points of the vectors.

    A shot reaches from the frame of its first sample to that of the next shot, the last to the number of ``frames`` of the key, and the first
    begins with frame 0 if its sample does. Its score is the mean of its frames, each of which has the score of the last sample at or before it.
    """
    starts = segmented(df.select(key, order, vector), key, order, vector, most, penalty).withColumn("_new", F.lit(1))
    w = Window.partitionBy(key).orderBy(order)
    at = df.join(starts, [key, order], "left").withColumn("shot", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumn("_span", F.coalesce(F.lead(frame).over(w), F.col(frames)) - F.col(frame))
    out = at.groupBy(key, "shot").agg(F.min(frame).alias("first"), F.max(F.col(frame) + F.col("_span")).alias("end"), F.sum("_span").alias("length"), (F.sum(F.col(score) * F.col("_span")) / F.sum("_span")).alias("score"))
    return out.select(key, "shot", "first", "end", "length", "score")


def shot_summary(df: DataFrame, key: str, order: str, vector: str, score: str, frame: str, frames: str, most: int, percent: int = 15, penalty: float = 1.0, whole: int | None = None) -> DataFrame:
    """The shots of each key that an exact knapsack keeps within floor(frames * percent / 100): (key, first, end).

    ``whole`` truncates scores times it to integers before they are compared. Fails for a key whose samples are outside its frames or repeat a frame.
    """
    order_of = Window.partitionBy(key).orderBy(order)
    wrong = (F.col(frame) < 0) | (F.col(frame) >= F.col(frames)) | F.coalesce(F.lag(frame).over(order_of) >= F.col(frame), F.lit(False))
    fault = F.raise_error(F.concat(F.lit("samples do not rise within the frames of "), F.col(key).cast("string"))).cast("boolean")
    sound = df.withColumn("_wrong", wrong).where(F.when(F.col("_wrong"), fault).otherwise(True)).drop("_wrong")
    found = shots(sound, key, order, vector, score, frame, frames, most, penalty)
    worth = F.floor(F.col("score") * whole).cast("double") if whole else F.col("score")
    limits = sound.groupBy(key).agg(F.floor(F.max(frames) * percent / 100).cast("long").alias("_budget"))
    chosen = within_budget(found.join(limits, key).withColumn("_worth", worth), key, "shot", "length", "_worth", budget="_budget")
    return found.join(chosen, [key, "shot"], "left_semi").select(key, "first", "end")


def bootstrap_mean(df: DataFrame, key: str, value: str, draws: int = 1000, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """Mean of the per-key means with a percentile interval over resampled keys. Each task weighs its keys in all draws; only sums meet."""
    each = df.groupBy(key).agg(F.avg(value).alias("v")).where("v is not null").select(F.xxhash64(key).alias("h"), "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(draws), np.zeros(draws)
        for rows in batches:
            for h, v in zip(rows["h"], rows["v"], strict=True):  # a key's Poisson weights depend on the key alone
                w = np.random.default_rng([seed, int(h) & (2**63 - 1)]).poisson(1.0, draws)
                total += w * v
                count += w
        yield pd.DataFrame({"draw": np.arange(draws), "total": total, "count": count})

    sums = each.mapInPandas(run, "draw int, total double, count double").groupBy("draw").agg(F.sum("total").alias("t"), F.sum("count").alias("c")).where("c > 0")
    low, high = (F.percentile(F.col("t") / F.col("c"), q) for q in (alpha / 2, 1 - alpha / 2))
    ends = sums.agg(low.alias("low"), high.alias("high"))
    return each.agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("keys")).crossJoin(F.broadcast(ends))  # one row each
