"""Interval algebra, range joins, windows and the threshold merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.intervals import chunk_count
from ..operators import intervals as iv
from .book import Book
from .tables import EV, HOUR, STRETCH, islands_sql, points, r6, spans, table

BOOK = Book()
BY = ["user_id"]


@BOOK.add(f"WITH {EV}, {islands_sql('pred', 'u')} SELECT user_id, s, e, n FROM u")
def interval_union(spark, d):
    return iv.coalesce(spans(spark, d, "purchase"), BY, STRETCH)


_METRICS = f"""WITH {EV}, {islands_sql('pred', 'a')}, long AS (SELECT * FROM ref WHERE e - s > {10 * HOUR}), {islands_sql('long', 'b')},
both_sides AS (SELECT a.user_id, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS x FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e GROUP BY a.user_id),
k AS (SELECT user_id FROM pred UNION SELECT user_id FROM ref),
t AS (SELECT k.user_id, CAST(coalesce((SELECT sum(e - s) FROM a WHERE a.user_id = k.user_id), 0) AS BIGINT) AS predicted, CAST(coalesce((SELECT sum(e - s) FROM b WHERE b.user_id = k.user_id), 0) AS BIGINT) AS reference,
 CAST(coalesce((SELECT x FROM both_sides c WHERE c.user_id = k.user_id), 0) AS BIGINT) AS "both", (SELECT count(*) FROM ref WHERE ref.user_id = k.user_id AND e - s <= {10 * HOUR}) AS excluded FROM k),
m AS (SELECT *, CASE WHEN predicted = 0 AND reference = 0 THEN 1 WHEN predicted > 0 THEN "both" / predicted ELSE 0 END AS p, CASE WHEN predicted = 0 AND reference = 0 THEN 1 WHEN reference > 0 THEN "both" / reference ELSE 0 END AS r FROM t)"""


def _metrics(spark, d):
    return iv.interval_metrics(spans(spark, d, "purchase"), spans(spark, d, "view"), BY, STRETCH, least=10 * HOUR)


@BOOK.add(
    f"""{_METRICS} SELECT user_id, predicted, reference, "both", excluded, round(p, 6) AS precision, round(r, 6) AS recall,
round(CASE WHEN predicted = 0 AND reference = 0 THEN 1 WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1,
round(CASE WHEN predicted = 0 AND reference = 0 THEN 1 ELSE "both" / (predicted + reference - "both") END, 6) AS tiou FROM m"""
)
def interval_metrics(spark, d):
    return _metrics(spark, d).select("user_id", "predicted", "reference", "both", "excluded", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "tiou")])


@BOOK.add(f"""{_METRICS} SELECT count(*) AS keys, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(sum("both") / sum(predicted), 6) AS micro_precision, round(sum("both") / sum(reference), 6) AS micro_recall FROM m""")
def interval_metrics_overall(spark, d):
    s = F.sum
    return _metrics(spark, d).agg(F.count(F.lit(1)).alias("keys"), r6(F.avg("precision")).alias("macro_precision"), r6(F.avg("recall")).alias("macro_recall"), r6(s("both") / s("predicted")).alias("micro_precision"), r6(s("both") / s("reference")).alias("micro_recall"))


@BOOK.add(
    f"""WITH {EV}, x AS (SELECT a.id, least(a.e, b.e) - greatest(a.s, b.s) AS i, (a.e - a.s) + (b.e - b.s) AS t FROM pred a JOIN ref b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e)
SELECT id, count(*) AS n, round(max(i / (t - i)), 6) AS best FROM x GROUP BY id"""
)
def interval_best_iou(spark, d):
    return iv.best_overlap(spans(spark, d, "purchase"), spans(spark, d, "view"), BY, STRETCH, "id").select("id", "n", r6("best").alias("best"))


@BOOK.add(f"WITH {EV} SELECT event_id, user_id FROM points p WHERE EXISTS (SELECT 1 FROM pred WHERE pred.user_id = p.user_id AND p.t >= s AND p.t < e)")
def interval_semi(spark, d):
    return iv.points_in(points(spark, d), spans(spark, d, "purchase"), BY, STRETCH, "left_semi").select("event_id", "user_id")


@BOOK.add(f"WITH {EV} SELECT event_id, user_id FROM points p WHERE NOT EXISTS (SELECT 1 FROM pred WHERE pred.user_id = p.user_id AND p.t >= s AND p.t < e)")
def interval_anti(spark, d):
    return iv.points_in(points(spark, d), spans(spark, d, "purchase"), BY, STRETCH, "left_anti").select("event_id", "user_id")


@BOOK.add(
    f"""WITH {EV}, m AS (SELECT p.event_id, i.id, i.score, row_number() OVER (PARTITION BY p.event_id ORDER BY i.score DESC, i.s, i.e - i.s DESC, i.id) AS k, count(*) OVER (PARTITION BY p.event_id) AS n
FROM points p JOIN pred i ON i.user_id = p.user_id AND p.t >= i.s AND p.t < i.e)
SELECT p.event_id, coalesce(m.n, 0) AS covering, m.id AS best_id, round(m.score, 6) AS score FROM points p LEFT JOIN m ON m.event_id = p.event_id AND m.k = 1"""
)
def interval_top1(spark, d):
    out = iv.best_cover(points(spark, d).drop("score"), spans(spark, d, "purchase"), BY, "event_id", STRETCH)
    return out.select("event_id", "covering", "best_id", r6("score").alias("score"))


@BOOK.add(
    f"""WITH {EV}, o AS (SELECT p.event_id, c.id % 50 AS w FROM points p JOIN chunk c ON c.user_id = p.user_id AND p.t >= c.s AND p.t < c.e),
h AS (SELECT DISTINCT p.event_id, a.id % 50 AS w FROM points p JOIN pred a ON a.user_id = p.user_id AND p.t >= a.s AND p.t < a.e),
j AS (SELECT o.event_id, count(DISTINCT o.w) AS exposure, count(h.w) AS support FROM o LEFT JOIN h ON o.event_id = h.event_id AND o.w = h.w GROUP BY o.event_id)
SELECT p.event_id, coalesce(exposure, 0) AS exposure, coalesce(support, 0) AS support, round(coalesce(support / nullif(exposure, 0), 0), 6) AS ratio FROM points p LEFT JOIN j ON j.event_id = p.event_id"""
)
def support_ratio(spark, d):
    window = (F.col("id") % 50).alias("window")
    return iv.support(points(spark, d), spans(spark, d, "signup").select("*", window), spans(spark, d, "purchase").select("*", window), BY, "event_id", STRETCH).select("event_id", "exposure", "support", r6("ratio").alias("ratio"))


@BOOK.add(
    f"""WITH {EV}, m AS (SELECT p.event_id, avg(r.vote) AS v, count(*) AS n FROM points p JOIN ref r ON r.user_id = p.user_id AND p.t >= r.s AND p.t < r.e GROUP BY p.event_id)
SELECT p.event_id, round(least(greatest(coalesce(v / 5, 0), 0), 1), 6) AS target, coalesce(n, 0) AS clips FROM points p LEFT JOIN m ON m.event_id = p.event_id"""
)
def soft_vote_target(spark, d):
    return iv.soft_votes(points(spark, d), spans(spark, d, "view"), BY, "event_id", STRETCH).select("event_id", r6("target").alias("target"), "clips")


@BOOK.add(
    f"""WITH {EV}, m AS (SELECT p.event_id, bool_or(p.t >= r.s AND p.t < r.e) AS pos, bool_or(abs(p.t - r.s) < {6 * HOUR} OR abs(p.t - r.e) < {6 * HOUR}) AS edge, count(DISTINCT CASE WHEN p.t >= r.s AND p.t < r.e THEN r.vote END) AS users
FROM points p JOIN ref r ON r.user_id = p.user_id AND p.t >= r.s - {6 * HOUR} AND p.t < r.e + {6 * HOUR} GROUP BY p.event_id)
SELECT p.event_id, coalesce(pos, false) AS positive, NOT coalesce(pos, false) AND coalesce(edge, false) AS guard, coalesce(users, 0) AS users FROM points p LEFT JOIN m ON m.event_id = p.event_id"""
)
def guard_mask(spark, d):
    return iv.guard_masks(points(spark, d), spans(spark, d, "view").withColumn("who", F.col("vote")), BY, "event_id", 6 * HOUR, STRETCH)


@BOOK.add(
    f"""WITH {EV}, f AS (SELECT DISTINCT user_id, unnest(generate_series((s * 3 + {HOUR * 10} - 1) // {HOUR * 10}, (e * 3 + {HOUR * 10} - 1) // {HOUR * 10} - 1)) AS frame FROM pred)
SELECT user_id, count(*) AS n, min(frame) AS first, max(frame) AS last FROM f GROUP BY user_id"""
)
def frame_projection(spark, d):
    """Union of the frames of a user's intervals at three frames in ten hours."""
    f = iv.frames(spans(spark, d, "purchase"), 3, 10 * HOUR).select("user_id", "frame").distinct()
    return f.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"))


_DURATION = "CAST(floor(o_totalprice / 1000) AS BIGINT)"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("duration"))


@BOOK.add(
    f"""WITH o AS (SELECT o_orderkey, {_DURATION} AS d FROM orders WHERE {_DURATION} > 0),
c AS (SELECT o_orderkey, d, unnest(range(0, CASE WHEN d <= 30 THEN 1 ELSE (d - 30 + 24) // 25 + 1 END)) AS chunk FROM o)
SELECT o_orderkey, chunk, chunk * 25 AS s, least(chunk * 25 + 30, d) AS e FROM c"""
)
def sliding_chunks(spark, d):
    return iv.sliding_chunks(_orders(spark, d), "duration", 30, 5).select("o_orderkey", "chunk", "s", "e")


@BOOK.add(f"SELECT o_orderkey, CAST(CASE WHEN {_DURATION} <= 30 THEN 1 ELSE ({_DURATION} - 30 + 24) // 25 + 1 END AS BIGINT) AS n FROM orders")
def chunk_counts(spark, d):
    return _orders(spark, d).select("o_orderkey", chunk_count(F.col("duration"), 30, 5).alias("n"))


@BOOK.add(
    f"""WITH o AS (SELECT o_orderkey, {_DURATION} AS d FROM orders WHERE {_DURATION} > 0), c AS (SELECT o_orderkey, d, unnest(range(0, (d + 19) // 20)) AS bin FROM o)
SELECT o_orderkey, bin, bin * 20 AS s, least((bin + 1) * 20, d) AS e FROM c"""
)
def tumbling_bins(spark, d):
    return iv.tumbling_bins(_orders(spark, d), "duration", 20).select("o_orderkey", "bin", "s", "e")


@BOOK.add(
    f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, id, s, e, score, row_number() OVER (PARTITION BY user_id ORDER BY s, e, score DESC, id) AS k FROM pred WHERE s < e),
f AS (SELECT user_id, k, 0 AS place, s, e, score, 1 AS n, CAST(id AS VARCHAR) AS ids FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.k, CASE WHEN j THEN f.place ELSE f.place + 1 END, CASE WHEN j THEN least(f.s, o.s) ELSE o.s END, CASE WHEN j THEN greatest(f.e, o.e) ELSE o.e END, CASE WHEN j THEN greatest(f.score, o.score) ELSE o.score END, CASE WHEN j THEN f.n + 1 ELSE 1 END, CASE WHEN j THEN concat(f.ids, ',', o.id) ELSE CAST(o.id AS VARCHAR) END
 FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1,
 LATERAL (SELECT greatest(0, least(f.e, o.e) - greatest(f.s, o.s)) AS i) a, LATERAL (SELECT a.i / ((f.e - f.s) + (o.e - o.s) - a.i) >= 0.3 AS j) b)
SELECT user_id, CAST(place AS BIGINT) AS place, arg_max(s, k) AS s, arg_max(e, k) AS e, round(arg_max(score, k), 6) AS score, CAST(max(n) AS BIGINT) AS n, arg_max(ids, k) AS ids FROM f GROUP BY user_id, place"""
)
def merge_fold(spark, d):
    return iv.fold_merge(spans(spark, d, "purchase"), BY, 0.3).select("user_id", "place", "s", "e", r6("score").alias("score"), "n", F.array_join("ids", ",").alias("ids"))
