"""A pool of items with a share for each bin and a cap for each user, which is relaxed while a bin is short."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shards import shared_folder


def _kept(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def build_pool(items: DataFrame, item: str, bin: str, user: str, order: str, wanted: dict[str, int], cap: int, most: int = 20) -> DataFrame:
    """The items of the pool, with ``round`` (the cap under which each was taken).

    Bins take turns by name. A bin takes its items in ``order`` (unique) until it has what is ``wanted``, but none of a user that has
    ``cap`` items in the pool already. While a bin is short, the cap goes up by one, to ``most`` at most, and bins with room take again.

    Under a cap, a bin takes of each user the first items that the user has room for, and of all those the first that it has room for: so each
    turn is a window over users and a top-k, without a loop over items. The driver holds a count for each bin. Null users count as one user.
    """
    items = items.where(F.col(bin).isin(list(wanted)))
    pool: DataFrame | None = None
    taken = dict.fromkeys(wanted, 0)
    for limit in range(cap, max(cap, most) + 1):
        for name in sorted(wanted):
            room = wanted[name] - taken[name]
            if room <= 0:
                continue
            free = items.where(F.col(bin) == name)
            if pool is not None:
                free = free.join(pool.select(item), item, "left_anti")
            # a task sorts no more than ``limit`` items of a user: the rest leaves before the shuffle
            place = F.row_number().over(Window.partitionBy(user).orderBy(order))
            free = free.withColumn("_k", place).where(F.col("_k") <= limit)
            if pool is not None:
                held = pool.groupBy(F.col(user).alias("_user")).agg(F.count(F.lit(1)).alias("_held"))
                free = free.join(held, free[user].eqNullSafe(F.col("_user")), "left").where(F.col("_k") <= limit - F.coalesce("_held", F.lit(0)))
            new = _kept(free.orderBy(order).limit(room).select(*items.columns, F.lit(limit).alias("round")))
            taken[name] += new.count()
            pool = new if pool is None else pool.unionByName(new)
        if all(taken[n] >= wanted[n] for n in wanted):
            break
    return pool if pool is not None else items.withColumn("round", F.lit(cap)).limit(0)


def shares(total: int, parts: dict[str, float]) -> dict[str, int]:
    """How many items each bin with a positive share gets: rounded half to even."""
    return {name: round(max(1, total) * share) for name, share in parts.items() if share > 0}
