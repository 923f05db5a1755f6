"""Samples, splits, quotas, selectors and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import hash_key, tie_hash
from ..operators import selection as se
from .book import Book
from .tables import BOXES, EV, boxes, events, r6, table

BOOK = Book()
_H = f"{EV}, h AS (SELECT *, sha256(concat_ws('|', 'seed', '7', kind, CAST(event_id AS VARCHAR))) AS h FROM ev), o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY h) AS place, count(*) OVER (PARTITION BY kind) AS n FROM h)"


def _key():
    return F.lit("seed"), F.lit(7), F.col("kind"), F.col("event_id")


@BOOK.add(
    f"""WITH {_H}, c AS (SELECT *, floor(n * 15 / 100) AS k FROM o)
SELECT event_id, CASE WHEN place <= n - 2 * k THEN 'TRAIN' WHEN place <= n - k THEN 'CALIBRATION' ELSE 'VALIDATION' END AS split FROM c"""
)
def hash_split(spark, d):
    return se.hash_split(events(spark, d), ["kind"], *_key()).select("event_id", "split")


@BOOK.add(f"WITH {_H} SELECT event_id, kind, CAST(place AS INT) AS place FROM o WHERE place <= 20")
def hash_quota(spark, d):
    return se.quota(events(spark, d), ["kind"], 20, *_key()).select("event_id", "kind", "place")


@BOOK.add(f"WITH {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY event_id) AS r FROM ev) SELECT event_id, kind, CAST(r AS INT) AS round FROM o ORDER BY r, kind LIMIT 33")
def round_robin(spark, d):
    return se.round_robin(events(spark, d), "kind", "event_id", 33).select("event_id", "kind", "round")


@BOOK.add(f"WITH {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev) SELECT event_id FROM o WHERE i IN (0, n // 4, 2 * n // 4, 3 * n // 4)")
def pick_even(spark, d):
    e = events(spark, d).withColumn("o", F.struct("t", "event_id"))
    return se.pick_even(e, ["user_id"], "o", 4).select("event_id")


@BOOK.add(f"WITH {EV} SELECT event_id, sha256(concat_ws('|', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR))) AS key, CAST(CAST(concat('0x', substr(sha256(concat_ws('|', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR))), 1, 16)) AS UBIGINT) AS VARCHAR) AS tie FROM ev")
def tie_hashes(spark, d):
    parts = F.col("user_id"), F.col("event_id")
    return events(spark, d).select("event_id", hash_key(*parts).alias("key"), tie_hash(*parts).cast("string").alias("tie"))


@BOOK.add(
    f"""WITH {EV}, x AS (SELECT *, concat(kind, ' ', vote) AS reason, max(score) OVER (PARTITION BY user_id) AS top FROM ev) SELECT event_id, true AS keep_all, score >= 0.5 AS by_threshold, score >= top - 0.1 AS relative,
NOT regexp_matches(reason, 'error|signup') OR regexp_matches(reason, '[45]$') AS by_text FROM x"""
)
def selector_rules(spark, d):
    e = events(spark, d).withColumn("reason", F.concat_ws(" ", "kind", F.col("vote").cast("string")))
    by = ["user_id"]
    rule = lambda name: se.selected(e, by, name, deny="error|signup", allow="[45]$")
    return e.select("event_id", rule("all").alias("keep_all"), rule("threshold").alias("by_threshold"), rule("relative").alias("relative"), rule("text").alias("by_text"))


@BOOK.add(
    f"""WITH {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC) AS k FROM boxes)
SELECT video, max(score) AS first, greatest(coalesce(max(score) FILTER (k = 2), 0.2), 0.2) AS second, round(max(score) - greatest(coalesce(max(score) FILTER (k = 2), 0.2), 0.2), 6) AS margin FROM o GROUP BY video"""
)
def top2_margin(spark, d):
    return se.with_margin(boxes(spark, d), ["video"], "score", 0.2).withColumn("margin", r6("margin"))


@BOOK.add(f"WITH {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, w * h DESC, ordinal) AS k, count(*) OVER (PARTITION BY video) AS n FROM boxes WHERE w >= 5) SELECT video, ordinal AS subject, n, CASE WHEN w * h > 400 THEN 'TOO_LARGE' WHEN score < 0.1 THEN 'LOW_SCORE' ELSE 'RELIABLE' END AS status FROM o WHERE k = 1")
def primary_subject(spark, d):
    b = boxes(spark, d).where("w >= 5").withColumn("area", F.col("w") * F.col("h"))
    top = b.groupBy("video").agg(F.max(F.struct("score", "area", (-F.col("ordinal")).alias("o"))).alias("b"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("b.area") > 400, "TOO_LARGE").when(F.col("b.score") < 0.1, "LOW_SCORE").otherwise("RELIABLE")
    return top.select("video", (-F.col("b.o")).alias("subject"), "n", status.alias("status"))


@BOOK.add(f"WITH {_H}, p AS (SELECT * FROM o WHERE kind = 'purchase'), v AS (SELECT * FROM o WHERE kind = 'view') SELECT p.event_id AS positive, v.event_id AS other FROM p JOIN v ON p.place = v.place")
def pair_sample(spark, d):
    """Pairs without replacement, dealt by hash order instead of a seeded generator."""
    o = se.hash_order(events(spark, d), ["kind"], *_key())
    side = lambda kind, name: o.where(F.col("kind") == kind).select("place", F.col("event_id").alias(name))
    return side("purchase", "positive").join(side("view", "other"), "place").select("positive", "other")


@BOOK.add(
    """WITH l AS (SELECT l_orderkey AS video, list(CAST(l_linenumber AS BIGINT) ORDER BY l_linenumber) AS items, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber) AS ws, list(l_extendedprice ORDER BY l_linenumber) AS vs, CAST(sum(l_quantity) AS BIGINT) * 40 // 100 AS room FROM lineitem GROUP BY 1),
m AS (SELECT *, unnest(range(CAST(2 ** len(items) AS BIGINT))) AS mask FROM l), s AS (SELECT video, items, room, mask, list_sum(list_transform(ws, lambda w, i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN w ELSE 0 END)) AS weight, list_sum(list_transform(vs, lambda v, i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN v ELSE 0 END)) AS worth FROM m),
b AS (SELECT video, items, arg_max(mask, (round(worth, 4), -mask)) AS mask FROM s WHERE weight <= room GROUP BY ALL)
SELECT video, unnest(list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1)) AS item FROM b"""
)
def knapsack(spark, d):
    """Lines of each order of the highest price within 40 % of its quantity."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("video"), F.col("l_linenumber").cast("bigint").alias("item"), F.col("l_quantity").cast("bigint").alias("weight"), F.col("l_extendedprice").alias("value"))
    return se.within_budget(line, "video", "item", "weight", "value", 40)


@BOOK.add()
def change_points(spark, d):
    """Segment starts in stretches of 64 embeddings of each label, so that no sequence grows with the table; held against a plain search in the tests."""
    seq = F.concat_ws("|", F.col("label").cast("string"), F.shiftright("vec_id", 6).cast("string"))
    e = table(spark, d, "embeddings").select(seq.alias("seq"), "vec_id", "embedding").where("embedding is not null")
    return se.segmented(e, "seq", "vec_id", "embedding", 8)


@BOOK.add()
def bootstrap_ci(spark, d):
    return se.bootstrap_mean(events(spark, d), "user_id", "score")
