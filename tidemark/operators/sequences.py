"""Ordered rows of a key: runs, ranks, differences, smoothing folds, as-of matches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_component(df: DataFrame, by: list[str], order: str, gap: int, name: str = "component") -> DataFrame:
    """Numbers the stretches of a key in which each row follows the one before by at most ``gap``."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.col(order) - F.lag(order).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(df: DataFrame, by: list[str], order: str, flag: Column, gap: int) -> DataFrame:
    """Maximal runs of rows with ``flag``, broken by a row without it and by a gap: (by, first, last, n)."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = df.select(*by, order, F.coalesce(flag, F.lit(False)).alias("f"))
    broken = F.when(F.col("f") & F.lag("f", 1, False).over(w) & (F.col(order) - F.lag(order).over(w) <= gap), 0).otherwise(1)
    marked = marked.withColumn("b", broken).withColumn("run", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("f").groupBy(*by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def pruned_edges(df: DataFrame, by: list[str], order: str, flag: Column, core: Column) -> DataFrame:
    """Marks rows to keep: runs of ``flag`` that touch the first or last row of a key go, if the key has a ``core`` row at all."""
    w = Window.partitionBy(*by).orderBy(order)
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_c", F.bool_or(F.coalesce(core, F.lit(False))).over(Window.partitionBy(*by)))
    edge = F.bool_and("_f").over(up) | F.bool_and("_f").over(down)
    return out.withColumn("keep", ~(F.col("_c") & edge)).drop("_f", "_c")


def persistence(df: DataFrame, by: list[str], order: str, flag: Column, reach: int) -> DataFrame:
    """Share of flagged rows within ``reach`` on either side, both ends included."""
    w = Window.partitionBy(*by).orderBy(order).rangeBetween(-reach, reach)
    return df.withColumn("persistence", F.avg(flag.cast("double")).over(w))


def motion(df: DataFrame, by: list[str], order: str, value: str, gap: int) -> DataFrame:
    """Displacement from the row before and change of displacement, null across gaps longer than ``gap``."""
    w = Window.partitionBy(*by).orderBy(order)
    near = F.col(order) - F.lag(order).over(w) <= gap
    out = df.withColumn("delta", F.when(near, F.col(value) - F.lag(value).over(w)))
    return out.withColumn("displacement", F.abs("delta")).withColumn("acceleration", F.when(F.col("delta").isNotNull(), F.abs(F.col("delta") - F.lag("delta").over(w))))


def average_rank(value: str, by: list[str]) -> Column:
    """1-based rank, ties share the mean of their places."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def standardised(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """Average rank, ordinal percentile rank, z-score (population) and min-max of a value; 0 where a key has no spread."""
    every = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(every)
    place = F.row_number().over(every.orderBy(value, tie)) - 1
    sd, low, high = F.stddev_pop(value).over(every), F.min(value).over(every), F.max(value).over(every)
    return df.select(
        "*",
        average_rank(value, by).alias("avg_rank"),
        F.when(n > 1, place / (n - 1)).otherwise(0.0).alias("percentile_rank"),
        F.when(sd > 0, (F.col(value) - F.avg(value).over(every)) / sd).otherwise(0.0).alias("zscore"),
        F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0).alias("min_max"),
    )


def smooth(df: DataFrame, by: list[str], order: str, value: str, gap: int, alpha: float = 0.5, adapt: tuple[float, float] | None = None, hold: tuple[str, str] | None = None, project: bool = False) -> DataFrame:
    """Exponential smoothing that starts anew for a key, after a gap and after a row without a value: adds ``smoothed`` and ``reset``.

    ``alpha`` weighs the new value. With ``adapt`` (low, high) it rises with the motion |value - state| from ``alpha`` at low to 1 at high.
    With ``hold`` (lowest, highest columns) the output is clipped between them; with ``project`` the clipped output is also the state.
    The fold is one per key: what a key holds must fit a task, as for one video.
    """
    lo, hi = (F.col(c) for c in hold) if hold else (F.lit(None).cast("double"), F.lit(None).cast("double"))
    item = F.struct(F.col(order).cast("bigint").alias("o"), F.col(value).cast("double").alias("v"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    row = "struct<o:bigint,state:double,out:double,reset:string>"

    def step(acc, x):
        last = F.element_at(acc, -1)
        fresh = F.size(acc) == 0
        why = F.when(fresh, "NEW_KEY").when(x["v"].isNull(), "NO_VALUE").when(x["o"] - last["o"] > gap, "GAP").when(last["state"].isNull(), "AFTER_NO_VALUE")
        a = F.lit(alpha)
        if adapt:
            share = (F.abs(x["v"] - last["state"]) - adapt[0]) / (adapt[1] - adapt[0])
            a = a + (1 - a) * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
        state = F.when(why.isNotNull(), x["v"]).otherwise(last["state"] + a * (x["v"] - last["state"]))
        out = F.when(state.isNotNull(), F.least(F.greatest(state, x["lo"]), x["hi"])) if hold else state
        new = F.struct(x["o"].alias("o"), (out if project else state).alias("state"), out.alias("out"), why.alias("reset"))
        return F.concat(acc, F.array(new)).cast(f"array<{row}>")

    folded = df.groupBy(*by).agg(F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(f"array<{row}>"), step).alias("x"))
    return folded.select(*by, F.explode("x").alias("x")).select(*by, F.col("x.o").alias(order), F.col("x.out").alias("smoothed"), F.col("x.reset").alias("reset"))


#: Why a row starts anew; the place of None is that of a row that does not.
RESETS = [None, "NEW_KEY", "NO_VALUE", "GAP", "AFTER_NO_VALUE"]


def _crop_fold(kept: list[str], gap: int, alpha: float, feedback: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The fold of ``guarded_crops`` over rows in order of key and place (`_n`): a step takes the next row of every key of a batch, and the last row's state goes on to the next batch."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = (0, False, 0.0, 0.0)  # order, has a state, the state
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            array = lambda name, none: column(name).fill_null(none).to_numpy(zero_copy_only=False)
            if column("sx").null_count or column("sy").null_count:
                raise ValueError("a row has no size of its crop")
            order, place = array("_o", 0), array("_n", 0)
            center = np.stack([array(f"c{c}", 0.0) for c in "xy"], axis=1)
            valid = column("cx").is_valid().to_numpy(zero_copy_only=False) & column("cy").is_valid().to_numpy(zero_copy_only=False)
            if not np.isfinite(center[valid]).all():
                raise ValueError("a centre is not finite")
            size = np.stack([array(f"s{c}", 0) for c in "xy"], axis=1)
            # as best_placements has it; fmin and fmax leave out nulls as least and greatest do
            whole, start, end = (np.stack([array(f"{k}{c}", np.nan) for c in "xy"], axis=1) for k in "wbe")
            legal = np.floor(whole - size)
            left, right = np.fmin(end - size, start), np.fmax(end - size, start)
            beyond = left > legal
            left, right = np.where(beyond, legal, np.fmax(left, 0)), np.where(beyond, legal, np.fmin(right, legal))
            overlap = lambda q: np.fmax(np.fmin(q + size, end) - np.fmax(q, start), 0)  # noqa: B023, E731
            hold = lambda q: np.fmin(np.fmax(q, 0), legal)  # noqa: B023, E731
            first, last, a, b = np.ceil(left), np.floor(right), hold(np.floor(left)), hold(np.ceil(right))
            on, of_first, of_a, of_b = first <= last, overlap(first), overlap(a), overlap(b)
            none = np.where(on, of_first, np.fmax(of_a, of_b)) == 0
            free = np.iinfo(np.int64).max
            bound = lambda q: np.where(np.isnan(q), free, np.nan_to_num(q).astype(np.int64))  # noqa: B023, E731
            low = np.where(none, 0, np.where(on, first, np.where(of_a >= of_b, a, b))).astype(np.int64)
            high, most = bound(np.where(none, legal, np.where(on, last, np.where(of_b >= of_a, b, a)))), bound(legal)
            begins = np.flatnonzero((place == 1) | (np.arange(n) == 0))
            lengths = np.diff(np.append(begins, n))
            longest = np.argsort(-lengths, kind="stable")
            begins, lengths = begins[longest], lengths[longest]
            # a key of the batch before goes on in the first row
            head = np.flatnonzero(begins == 0)[0]
            o, has, state = np.zeros(len(begins), np.int64), np.zeros(len(begins), bool), np.zeros((len(begins), 2))
            o[head], has[head], state[head] = carry[0], carry[1], carry[2:]
            why, proposed, placed = np.zeros(n, np.int8), np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
            for k in range(lengths[0]):
                m = np.searchsorted(-lengths, -k, side="left")
                at = begins[:m] + k
                ok, v, s = valid[at], center[at], size[at]
                reset = np.where(place[at] == 1, 1, np.where(~ok, 2, np.where(order[at] - o[:m] > gap, 3, np.where(~has[:m], 4, 0))))
                now = np.where((reset > 0)[:, None], v, state[:m] + alpha * (v - state[:m]))
                p = np.minimum(np.maximum(np.floor(now - s / 2).astype(np.int64), 0), most[at])
                q = np.minimum(np.maximum(p, low[at]), high[at])
                state[:m] = now if feedback == "none" else now + (q - p) if feedback == "offset" else q + s / 2
                o[:m], has[:m], why[at], proposed[at], placed[at] = order[at], ok, reset, p, q
            tail = np.flatnonzero(begins + lengths == n)[0]
            carry = (o[tail], has[tail], *state[tail])
            crops = [pa.array(v[:, k], mask=~valid) for v in (placed, proposed) for k in (0, 1)]
            text = pa.array(np.array(RESETS, object)[why], pa.string())
            yield pa.RecordBatch.from_arrays([column(c) for c in kept] + crops + [text], [*kept, "x", "y", "px", "py", "reset"])

    return fold


def guarded_crops(df: DataFrame, by: list[str], order: str, center: tuple[str, str], box: tuple[str, str, str, str], extent: tuple[str, str], crop: tuple[str, str], gap: int, alpha: float = 0.5, feedback: str = "none") -> DataFrame:
    """Smoothed crops of a fixed size that show as much of a box as can be: adds x, y, reset, guarded, visible_before, visible_after.

    The state is a centre, smoothed on both axes as in ``smooth``. Its crop is the proposal; on each axis it is moved into the offsets of
    greatest overlap with the box (corners ``box``). ``feedback`` says what the next row starts from: 'none' the state, 'offset' the state
    moved by the correction, 'canonical' the centre of the crop that came out. Rows without a centre have no crop and end a stretch; a row
    without a size of its crop fails. A task folds all its keys side by side, row by row, so it holds a batch and not a key.
    """
    if feedback not in ("none", "offset", "canonical"):
        raise ValueError(f"no feedback {feedback}")
    axes = []
    for k, c in enumerate("xy"):
        of = {"c": center[k], "w": extent[k], "b": box[k], "e": box[k + 2]}
        axes += [F.col(of[x]).cast("double").alias(f"{x}{c}") for x in of] + [F.col(crop[k]).cast("bigint").alias(f"s{c}")]
    known = [F.col(c).isNotNull() for c in [*by, order]]
    rows = df.where(reduce(lambda a, b: a & b, known)).select(*by, F.col(order), F.col(order).cast("bigint").alias("_o"), *axes)
    # the window puts a key's rows one after the other, in order, and counts them
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_o", "cx", "cy")))
    kinds = dict(rows.dtypes)
    kept = [*by, order, "bx", "by", "ex", "ey", "sx", "sy"]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + ["x long, y long, px long, py long, reset string"])
    both = rows.mapInArrow(_crop_fold(kept, gap, alpha, feedback), schema).withColumnsRenamed({"bx": "_b0", "by": "_b1", "ex": "_b2", "ey": "_b3", "sx": "_s0", "sy": "_s1"})
    overlap = lambda at, k: F.greatest(F.least(F.col(at) + F.col(f"_s{k}"), F.col(f"_b{k + 2}")) - F.greatest(F.col(at).cast("double"), F.col(f"_b{k}")), F.lit(0.0))
    shown = lambda x, y: overlap(x, 0) * overlap(y, 1) / F.nullif((F.col("_b2") - F.col("_b0")) * (F.col("_b3") - F.col("_b1")), F.lit(0.0))
    moved = (F.col("x") != F.col("px")) | (F.col("y") != F.col("py"))
    return both.select(*by, order, "x", "y", "reset", moved.alias("guarded"), shown("px", "py").alias("visible_before"), shown("x", "y").alias("visible_after"))


def asof(left: DataFrame, right: DataFrame, by: list[str], how: str = "backward") -> DataFrame:
    """Time of the nearest row of ``right`` (by, t): ``backward`` at or before, ``forward`` at or after, ``nearest`` of both, ties to the earlier.

    One union and one window per direction; no pairs are made. Adds ``match``.
    """
    both = left.withColumn("_left", F.lit(1)).unionByName(right.select(*by, "t").withColumn("_left", F.lit(0)), allowMissingColumns=True)
    other = F.when(F.col("_left") == 0, F.col("t"))
    w = Window.partitionBy(*by).orderBy("t", "_left")
    v = Window.partitionBy(*by).orderBy(F.desc("t"), "_left")
    up = F.last(other, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.last(other, ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, 0))
    if how == "nearest":
        both = both.withColumn("_a", up).withColumn("_b", down)
        match = F.when(F.col("_b").isNull() | (F.col("t") - F.col("_a") <= F.col("_b") - F.col("t")), F.col("_a")).otherwise(F.col("_b"))
        return both.withColumn("match", match).where("_left = 1").select(*left.columns, "match")
    return both.withColumn("match", up if how == "backward" else down).where("_left = 1").select(*left.columns, "match")


def first_row(df: DataFrame, by: list[str], *order: Column, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key, numbered ``place`` from 1. Spark cuts groups before the shuffle (window group limit)."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)
