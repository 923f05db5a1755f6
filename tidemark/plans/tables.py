"""Projections of the driver's tables that the queries run on, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Length of a stretch of time in range joins: five days in microseconds.
STRETCH = 5 * 86_400_000_000
HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), "value", t.alias("t"), (F.col("value") / (F.col("value") + 50)).alias("score"), (F.col("event_id") % 6).alias("vote"))


def spans(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Events of a kind as intervals: the value read as hours."""
    end = F.col("t") + F.round(F.col("value") * 100).cast("bigint") * 36_000_000
    return events(spark, sf_dir).where(F.col("kind") == kind).select("user_id", F.col("event_id").alias("id"), F.col("t").alias("s"), end.alias("e"), "score", "vote")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("kind = 'click'").select("event_id", "user_id", "t", "score")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("video"), F.col("l_linenumber").cast("bigint").alias("frame"), (F.col("l_partkey") % 100).cast("double").alias("x"), (F.col("l_suppkey") % 100).cast("double").alias("y"),
        F.col("l_quantity").alias("w"), (F.round(F.col("l_discount") * 100) + 1).alias("h"), F.round(F.col("l_tax") * 10, 2).alias("score"), (F.col("l_linenumber").cast("bigint") * 10_000_000 + F.col("l_partkey")).alias("ordinal"),
    )


EV = """ev AS (SELECT event_id, user_id, event_type AS kind, value, epoch_us(ts) AS t, value / (value + 50) AS score, event_id % 6 AS vote FROM events),
spans AS (SELECT user_id, event_id AS id, t AS s, t + CAST(round(value * 100) AS BIGINT) * 36000000 AS e, score, vote, kind FROM ev),
pred AS (SELECT * FROM spans WHERE kind = 'purchase'), ref AS (SELECT * FROM spans WHERE kind = 'view'), chunk AS (SELECT * FROM spans WHERE kind = 'signup'),
points AS (SELECT event_id, user_id, t, score FROM ev WHERE kind = 'click')"""

BOXES = """boxes AS (SELECT l_orderkey AS video, CAST(l_linenumber AS BIGINT) AS frame, CAST(l_partkey % 100 AS DOUBLE) AS x, CAST(l_suppkey % 100 AS DOUBLE) AS y,
l_quantity AS w, round(l_discount * 100) + 1 AS h, round(l_tax * 10, 2) AS score, CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey AS ordinal FROM lineitem)"""


def islands_sql(src: str, out: str) -> str:
    """CTEs that end in ``out`` (user_id, s, e, n): the union of the intervals of ``src``."""
    w = "PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""{out}_m AS (SELECT *, CASE WHEN s <= max(e) OVER ({w} 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {src} WHERE s < e),
{out}_i AS (SELECT *, sum(new) OVER ({w} CURRENT ROW) AS island FROM {out}_m), {out} AS (SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM {out}_i GROUP BY user_id, island)"""


def iou_sql(a: str, b: str) -> str:
    """IoU of the boxes (x, y, w, h) of two aliases."""
    both = f"greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    return f"coalesce({both} / nullif({a}.w * {a}.h + {b}.w * {b}.h - {both}, 0), 0)"
