"""Runs, ranks, motion, smoothing and as-of matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as sq
from .book import Book
from .tables import EV, HOUR, events, points, r6

BOOK = Book()
BY = ["user_id"]
_DAY = 24 * HOUR
_SEQ = f"{EV}, q AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, t, value, kind, event_id FROM ev)"


def _seq(spark, d):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).cast("bigint")
    return events(spark, d).withColumn("i", i).select("user_id", "i", "t", "value", "kind", "event_id")


@BOOK.add(
    f"""WITH {EV}, x AS (SELECT user_id, t, value > 100 AS f, lag(value > 100, 1, false) OVER w AS g, t - lag(t) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)),
y AS (SELECT *, sum(CASE WHEN f AND g AND gap <= {_DAY} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n FROM y WHERE f GROUP BY user_id, run"""
)
def run_extract(spark, d):
    return sq.runs(events(spark, d), BY, "t", F.col("value") > 100, _DAY)


@BOOK.add(
    f"""WITH {EV}, x AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {_DAY} THEN 0 ELSE 1 END AS b FROM ev),
y AS (SELECT user_id, t, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS component FROM x) SELECT user_id, CAST(component AS BIGINT) AS component, count(*) AS n FROM y GROUP BY ALL"""
)
def gap_components(spark, d):
    return sq.with_component(events(spark, d), BY, "t", _DAY).groupBy("user_id", "component").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add(
    f"""WITH {_SEQ}, x AS (SELECT *, bool_or(value > 480) OVER (PARTITION BY user_id) AS core, bool_and(value < 200) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS up,
bool_and(value < 200) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS down FROM q) SELECT event_id, NOT (core AND (up OR down)) AS keep FROM x"""
)
def edge_prune(spark, d):
    return sq.pruned_edges(_seq(spark, d), BY, "i", F.col("value") < 200, F.col("value") > 480).select("event_id", "keep")


@BOOK.add(f"WITH {EV} SELECT event_id, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {_DAY} PRECEDING AND {_DAY} FOLLOWING), 6) AS persistence FROM ev")
def persistence_range(spark, d):
    return sq.persistence(events(spark, d), BY, "t", F.col("value") > 100, _DAY).select("event_id", r6("persistence").alias("persistence"))


@BOOK.add(
    f"""WITH {EV}, x AS (SELECT user_id, event_id, t, CASE WHEN t - lag(t) OVER w <= {_DAY} THEN value - lag(value) OVER w END AS delta FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)),
y AS (SELECT *, abs(delta) AS displacement, CASE WHEN delta IS NOT NULL THEN abs(delta - lag(delta) OVER (PARTITION BY user_id ORDER BY t)) END AS acceleration FROM x)
SELECT user_id, count(displacement) AS pairs, count(acceleration) AS triplets, round(avg(displacement), 6) AS mean_displacement, round(max(acceleration), 6) AS max_acceleration FROM y GROUP BY user_id"""
)
def motion(spark, d):
    m = sq.motion(events(spark, d), BY, "t", "value", _DAY)
    return m.groupBy("user_id").agg(F.count("displacement").alias("pairs"), F.count("acceleration").alias("triplets"), r6(F.avg("displacement")).alias("mean_displacement"), r6(F.max("acceleration")).alias("max_acceleration"))


@BOOK.add(
    f"""WITH {EV}, x AS (SELECT event_id, user_id, value, rank() OVER (PARTITION BY user_id ORDER BY round(value)) + (count(*) OVER (PARTITION BY user_id, round(value)) - 1) / 2 AS avg_rank,
row_number() OVER (PARTITION BY user_id ORDER BY round(value), event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n, round(value) AS v FROM ev)
SELECT event_id, round(avg_rank, 6) AS avg_rank, round(CASE WHEN n > 1 THEN k / (n - 1) ELSE 0 END, 6) AS percentile_rank,
round(coalesce((v - avg(v) OVER p) / nullif(stddev_pop(v) OVER p, 0), 0), 6) AS zscore, round(coalesce((v - min(v) OVER p) / nullif(max(v) OVER p - min(v) OVER p, 0), 0), 6) AS min_max FROM x WINDOW p AS (PARTITION BY user_id)"""
)
def rank_and_scale(spark, d):
    out = sq.standardised(events(spark, d).withColumn("v", F.round("value")), BY, "v", "event_id")
    return out.select("event_id", *[r6(c).alias(c) for c in ("avg_rank", "percentile_rank", "zscore", "min_max")])


def _ema_sql(alpha: str, out: str, state: str) -> str:
    return f"""WITH RECURSIVE {_SEQ}, f AS (SELECT user_id, i, t, value AS state, {out.replace('@', 'value')} AS smoothed, 'NEW_KEY' AS reset FROM q WHERE i = 1
 UNION ALL SELECT user_id, i, t, {state}, {out.replace('@', 'z')}, reset FROM (SELECT q.user_id, q.i, q.t, q.value, CASE WHEN q.t - f.t > {_DAY} THEN 'GAP' END AS reset,
 CASE WHEN q.t - f.t > {_DAY} THEN q.value ELSE f.state + ({alpha}) * (q.value - f.state) END AS z FROM f JOIN q ON q.user_id = f.user_id AND q.i = f.i + 1) g)
SELECT user_id, t, round(smoothed, 6) AS smoothed, reset FROM f"""


def _smooth(spark, d, **settings):
    df = events(spark, d).withColumn("lo", F.lit(20.0)).withColumn("hi", F.lit(60.0))
    return sq.smooth(df, BY, "t", "value", _DAY, **settings).select("user_id", "t", r6("smoothed").alias("smoothed"), "reset")


@BOOK.add(_ema_sql("0.5", "@", "z"))
def ema_reset(spark, d):
    return _smooth(spark, d)


@BOOK.add(_ema_sql("0.4", "@", "z"))
def ema_old_weighted(spark, d):
    """The variant whose weight, 0.6, is that of the previous value."""
    return _smooth(spark, d, alpha=0.4)


@BOOK.add(_ema_sql("0.5 + 0.5 * least(greatest((abs(q.value - f.state) - 20) / 80, 0), 1)", "@", "z"))
def ema_adaptive(spark, d):
    return _smooth(spark, d, adapt=(20.0, 100.0))


@BOOK.add(_ema_sql("0.5", "least(greatest(@, 20), 60)", "z"))
def ema_guarded(spark, d):
    return _smooth(spark, d, hold=("lo", "hi"))


@BOOK.add(_ema_sql("0.5", "least(greatest(@, 20), 60)", "least(greatest(z, 20), 60)").replace("value AS state", "least(greatest(value, 20), 60) AS state"))
def ema_projected(spark, d):
    return _smooth(spark, d, hold=("lo", "hi"), project=True)


def _right(spark, d):
    return events(spark, d).where("kind = 'view'").select("user_id", "t")


_VIEWS = f"WITH {EV}, v AS (SELECT DISTINCT user_id, t FROM ev WHERE kind = 'view')"


@BOOK.add(f"{_VIEWS} SELECT p.event_id, v.t AS match FROM points p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t")
def asof_backward(spark, d):
    return sq.asof(points(spark, d), _right(spark, d), BY).select("event_id", "match")


@BOOK.add(f"{_VIEWS} SELECT p.event_id, v.t AS match FROM points p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t <= v.t")
def asof_forward(spark, d):
    return sq.asof(points(spark, d), _right(spark, d), BY, "forward").select("event_id", "match")


@BOOK.add(
    f"""{_VIEWS}, x AS (SELECT p.event_id, v.t AS match, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - v.t), v.t) AS k FROM points p JOIN v ON v.user_id = p.user_id)
SELECT p.event_id, x.match FROM points p LEFT JOIN x ON x.event_id = p.event_id AND x.k = 1"""
)
def asof_nearest(spark, d):
    return sq.asof(points(spark, d), _right(spark, d), BY, "nearest").select("event_id", "match")


@BOOK.add(f"WITH {EV}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, t, event_id) AS place FROM ev) SELECT user_id, event_id, CAST(place AS INT) AS place FROM x WHERE place <= 3")
def top_k(spark, d):
    """The three best events of each user: a top-k by definition."""
    return sq.first_row(events(spark, d), BY, F.desc("score"), F.col("t"), F.col("event_id"), k=3).select("user_id", "event_id", "place")
