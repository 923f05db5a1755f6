"""Exact matches, comparisons, gates, boxes and record checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions.scalars import bucket_label, lenient_double, parse_rate
from ..operators import matching as mt
from ..sources import records as rec
from .book import Book
from .tables import BOXES, EV, boxes, events, iou_sql, r6, table

BOOK = Book()

_PR = f"""WITH {BOXES}, p AS (SELECT * FROM boxes WHERE frame <= 4), r AS (SELECT video, frame, x + 5 AS x, y, w + 2 AS w, h FROM boxes WHERE frame >= 2 AND frame <= 6),
j AS (SELECT coalesce(p.video, r.video) AS video, p.x AS px, r.x AS rx, CASE WHEN p.x IS NOT NULL AND r.x IS NOT NULL THEN {iou_sql('p', 'r')} END AS v FROM p FULL JOIN r ON p.video = r.video AND p.frame = r.frame)"""


def _sides(spark, d):
    b = boxes(spark, d)
    ref = b.where("frame between 2 and 6").select("video", "frame", (F.col("x") + 5).alias("x"), "y", (F.col("w") + 2).alias("w"), "h")
    return b.where("frame <= 4"), ref


@BOOK.add(
    f"""{_PR}, t AS (SELECT video, count(px) AS predicted, count(rx) AS reference, count(v) AS common, coalesce(sum(v), 0) AS total FROM j GROUP BY video),
m AS (SELECT *, CASE WHEN predicted > 0 THEN total / predicted ELSE 0 END AS p, CASE WHEN reference > 0 THEN total / reference ELSE 0 END AS r FROM t)
SELECT video, predicted, reference, common, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m"""
)
def exact_frame_match(spark, d):
    out = mt.frame_match(*_sides(spark, d), ["video"], "frame")
    return out.select("video", "predicted", "reference", "common", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


_SETS = f"""WITH {EV}, p AS (SELECT DISTINCT user_id, t // 86400000000 AS day FROM ev WHERE kind = 'purchase'), r AS (SELECT DISTINCT user_id, t // 86400000000 AS day FROM ev WHERE kind = 'view'),
t AS (SELECT coalesce(p.user_id, r.user_id) AS user_id, count(p.day) AS predicted, count(r.day) AS reference, count_if(p.day IS NOT NULL AND r.day IS NOT NULL) AS common FROM p FULL JOIN r ON p.user_id = r.user_id AND p.day = r.day GROUP BY 1),
m AS (SELECT *, coalesce(common / nullif(predicted, 0), 0) AS p, coalesce(common / nullif(reference, 0), 0) AS r FROM t)"""


def _days(spark, d, kind):
    return events(spark, d).where(F.col("kind") == kind).select("user_id", F.expr("t div 86400000000").alias("day"))


@BOOK.add(f"{_SETS} SELECT user_id, predicted, reference, CAST(common AS BIGINT) AS common, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m")
def set_metrics(spark, d):
    out = mt.set_metrics(_days(spark, d, "purchase"), _days(spark, d, "view"), ["user_id"], "day")
    return out.select("user_id", "predicted", "reference", "common", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@BOOK.add(
    f"""{_SETS} SELECT count(*) AS keys, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1,
round(sum(common) / sum(predicted), 6) AS micro_precision, round(sum(common) / sum(reference), 6) AS micro_recall FROM m"""
)
def macro_micro(spark, d):
    out = mt.macro_micro(mt.set_metrics(_days(spark, d, "purchase"), _days(spark, d, "view"), ["user_id"], "day"))
    return out.select("keys", *[r6(c).alias(c) for c in out.columns if c != "keys"])


_ARMS = f"WITH {EV}, a AS (SELECT user_id, t // 86400000000 AS day, count(*) AS n FROM ev WHERE kind = 'purchase' GROUP BY ALL), b AS (SELECT user_id, t // 86400000000 AS day, count(*) AS n FROM ev WHERE kind = 'view' GROUP BY ALL)"


def _arm(spark, d, kind):
    return _days(spark, d, kind).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add(
    f"""{_ARMS} SELECT coalesce(a.user_id, b.user_id) AS user_id, CAST(count_if(b.n IS NULL) AS BIGINT) AS only_left, CAST(count_if(a.n IS NULL) AS BIGINT) AS only_right, CAST(count_if(coalesce(a.n = b.n, false)) AS BIGINT) AS equal, CAST(count_if(a.n IS NOT NULL AND b.n IS NOT NULL) AS BIGINT) AS matched,
round(avg(abs(a.n - b.n)), 6) AS mean_n FROM a FULL JOIN b ON a.user_id = b.user_id AND a.day = b.day GROUP BY 1"""
)
def compare_arms(spark, d):
    out = mt.compare_arms(_arm(spark, d, "purchase"), _arm(spark, d, "view"), ["user_id", "day"], ["n"], ["user_id"])
    return out.withColumn("mean_n", r6("mean_n"))


@BOOK.add(
    f"""WITH {EV}, a AS (SELECT user_id, avg(value) AS v FROM ev WHERE kind = 'purchase' GROUP BY 1), b AS (SELECT user_id, avg(value) AS v FROM ev WHERE kind = 'view' GROUP BY 1)
SELECT count_if(b.v - a.v > 5) AS wins, count_if(abs(b.v - a.v) <= 5) AS ties, count_if(b.v - a.v < -5) AS losses, round(avg(b.v - a.v), 6) AS mean_delta FROM a JOIN b USING (user_id)"""
)
def paired_win_tie_loss(spark, d):
    arm = lambda kind: events(spark, d).where(F.col("kind") == kind).groupBy("user_id").agg(F.avg("value").alias("v"))
    return mt.paired(arm("purchase"), arm("view"), "user_id", "v", 5.0).withColumn("mean_delta", r6("mean_delta"))


@BOOK.add(
    """WITH e AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'), p AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 AND l_returnflag <> 'R' GROUP BY 1),
t AS (SELECT count_if(p.n IS NULL) AS missing, count_if(e.k IS NULL) AS extra, count_if(p.n > 1) AS duplicate FROM e FULL JOIN p ON e.k = p.k) SELECT missing, extra, duplicate, missing = 0 AND extra = 0 AND duplicate = 0 AS ok FROM t"""
)
def integrity_gate(spark, d):
    expected = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    produced = table(spark, d, "lineitem").where("l_linenumber <= 2 and l_returnflag <> 'R'").select(F.col("l_orderkey").alias("k"))
    return mt.integrity(expected, produced, ["k"])


@BOOK.add(
    f"""WITH {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, w * h DESC, ordinal) AS k FROM boxes),
b AS (SELECT * FROM o WHERE k = 1) SELECT b.video, b.ordinal AS best, CAST(count_if(o.ordinal <> b.ordinal AND b.score - o.score <= 0.2 AND {iou_sql('b', 'o')} < 0.3) AS BIGINT) AS contenders FROM b JOIN o ON o.video = b.video GROUP BY ALL"""
)
def theta_contenders(spark, d):
    return mt.contenders(boxes(spark, d), "video", 0.2, 0.3)


@BOOK.add("SELECT DISTINCT key FROM (SELECT CAST(unnest([l_orderkey, l_partkey, l_suppkey]) AS VARCHAR) AS key FROM lineitem)")
def exclusion_union(spark, d):
    return mt.unpivot(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])


@BOOK.add("SELECT p_partkey FROM part WHERE CAST(p_partkey AS VARCHAR) IN (SELECT CAST(unnest([l_orderkey, l_suppkey]) AS VARCHAR) FROM lineitem)")
def source_leakage(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("key"))
    return part.join(mt.unpivot(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"]), "key", "left_semi").select("p_partkey")


@BOOK.add(
    f"""WITH {EV}, a AS (SELECT DISTINCT user_id FROM ev WHERE kind = 'error' AND value > 300), u AS (SELECT DISTINCT user_id FROM ev) SELECT u.user_id, CASE WHEN a.user_id IS NOT NULL THEN 'audit' WHEN u.user_id % 2 = 0 THEN 'dev' ELSE 'hard' END AS role FROM u LEFT JOIN a ON a.user_id = u.user_id"""
)
def role_partition(spark, d):
    e = events(spark, d)
    audit = e.where("kind = 'error' and value > 300").select("user_id").distinct().withColumn("a", F.lit(1))
    role = F.when(F.col("a") == 1, "audit").when(F.col("user_id") % 2 == 0, "dev").otherwise("hard")
    return e.select("user_id").distinct().join(audit, "user_id", "left").select("user_id", role.alias("role"))


@BOOK.add(f"WITH {EV} SELECT user_id, arg_min(event_id, (t, event_id)) AS event_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM ev GROUP BY user_id")
def first_per_id(spark, d):
    e = events(spark, d)
    return e.groupBy("user_id").agg(F.min(F.struct("t", "event_id")).alias("f"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")).select("user_id", "f.event_id", "n", "kinds")


@BOOK.add(f"WITH {EV} SELECT user_id, arg_max(event_id, t) AS event_id, arg_max(value, t) AS value FROM ev GROUP BY user_id")
def last_by_key(spark, d):
    return rec.last_by_key(events(spark, d).select("user_id", "event_id", "value", "t"), ["user_id"], F.col("t")).select("user_id", "event_id", "value")


@BOOK.add(f"WITH {BOXES} SELECT a.video, a.frame, round({iou_sql('a', 'b')}, 6) AS iou FROM boxes a JOIN boxes b ON a.video = b.video AND b.frame = a.frame + 1")
def box_iou(spark, d):
    b = boxes(spark, d)
    nxt = b.select("video", (F.col("frame") - 1).alias("frame"), *[F.col(c).alias(f"{c}2") for c in "xywh"])
    value = bx.iou(bx.corners(*(F.col(c) for c in "xywh")), bx.corners(*(F.col(f"{c}2") for c in "xywh")))
    return b.join(nxt, ["video", "frame"]).select("video", "frame", r6(value).alias("iou"))


_RAW = f"WITH {BOXES}, r AS (SELECT video, frame, x - 20 AS x1, y - 40 AS y1, x - 20 + w AS x2, y - 40 + h AS y2, 60 AS width, 50 AS height FROM boxes)"


@BOOK.add(
    f"""{_RAW}, c AS (SELECT *, least(greatest(x1, 0), width) AS a1, least(greatest(y1, 0), height) AS b1, least(greatest(x2, 0), width) AS a2, least(greatest(y2, 0), height) AS b2 FROM r)
SELECT video, frame, a1 AS x1, b1 AS y1, a2 AS x2, b2 AS y2, CASE WHEN a2 <= a1 OR b2 <= b1 THEN 'INVALID' ELSE 'OK' END AS status, greatest(-x1, 0) + greatest(-y1, 0) + greatest(x2 - width, 0) + greatest(y2 - height, 0) AS overflow FROM c"""
)
def sanitize_box(spark, d):
    x, y = F.col("x") - 20, F.col("y") - 40
    b = (x, y, x + F.col("w"), y + F.col("h"))
    w, h = F.lit(60.0), F.lit(50.0)
    c, over = bx.clamp(b, w, h), bx.overflow(b, w, h)
    return boxes(spark, d).select("video", "frame", *[v.alias(n) for v, n in zip(c, ("x1", "y1", "x2", "y2"), strict=True)], bx.status(b, w, h).alias("status"), (over[0] + over[1] + over[2] + over[3]).alias("overflow"))


_CROP = """WITH s AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 40 + 320 AS fw, 480 + (p_partkey % 7) * 120 AS fh, (p_partkey % 100) * 20 AS cx, (p_partkey % 13) * 60 AS cy FROM part),
c AS (SELECT *, CASE WHEN fw * 16 >= fh * 9 THEN fh * 9 // 16 ELSE fw END AS w, CASE WHEN fw * 16 >= fh * 9 THEN fh ELSE fw * 16 // 9 END AS h FROM s)"""


def _frames(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", (F.col("p_size").cast("bigint") * 40 + 320).alias("fw"), (480 + (k % 7) * 120).alias("fh"), ((k % 100) * 20).alias("cx"), ((k % 13) * 60).alias("cy"))


@BOOK.add(f"{_CROP} SELECT p_partkey, CAST(least(greatest(floor(fw / 2 - w / 2), 0), fw - w) AS BIGINT) AS x, CAST(least(greatest(floor(fh / 2 - h / 2), 0), fh - h) AS BIGINT) AS y, w, h FROM c")
def center_crop(spark, d):
    f = _frames(spark, d)
    x, y, w, h = bx.crop_at(F.col("fw"), F.col("fh"), 9, 16, F.col("fw") / 2, F.col("fh") / 2)
    return f.select("p_partkey", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


@BOOK.add(
    f"""{_CROP}, p AS (SELECT *, CAST(least(greatest(floor(cx - w / 2), 0), fw - w) AS BIGINT) AS x, CAST(least(greatest(floor(cy - h / 2), 0), fh - h) AS BIGINT) AS y FROM c)
SELECT p_partkey, x, y, w, h, cx >= x AND cx < x + w AND cy >= y AND cy < y + h AS inside, round(greatest(0, least(cx + 50, x + w) - greatest(cx - 50, x)) * greatest(0, least(cy + 50, y + h) - greatest(cy - 50, y)) / 10000, 6) AS visible FROM p"""
)
def subject_crop(spark, d):
    f = _frames(spark, d)
    cx, cy = F.col("cx"), F.col("cy")
    x, y, w, h = bx.crop_at(F.col("fw"), F.col("fh"), 9, 16, cx, cy)
    f = f.select("p_partkey", "cx", "cy", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    crop = bx.corners(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    subject = tuple(v.cast("double") for v in (cx - 50, cy - 50, cx + 50, cy + 50))
    return f.select("p_partkey", "x", "y", "w", "h", bx.inside(cx, cy, crop).alias("inside"), r6(bx.visible_fraction(subject, crop)).alias("visible"))


@BOOK.add(
    f"""WITH {BOXES}, n AS (SELECT video, frame, x / 200 AS a, y / 200 AS b, (x + w) / 200 AS c, (y + h) / 200 AS d FROM boxes)
SELECT video, frame, round(greatest(a - (c - a) * 0.35, 0), 6) AS x1, round(greatest(b - (d - b) * 0.35, 0), 6) AS y1, round(least(c + (c - a) * 0.35, 1), 6) AS x2, round(least(d + (d - b) * 0.35, 1), 6) AS y2,
CASE WHEN abs((a + c) / 2 - 0.5) < 0.1 THEN 'near_center' WHEN abs((a + c) / 2 - 0.5) < 0.25 THEN 'off_center' ELSE 'strongly_off_center' END AS stratum FROM n"""
)
def focus_window(spark, d):
    b = (F.col("x") / 200, F.col("y") / 200, (F.col("x") + F.col("w")) / 200, (F.col("y") + F.col("h")) / 200)
    out = bx.focus_window(b, 0.35)
    offset = F.abs((b[0] + b[2]) / 2 - 0.5)
    return boxes(spark, d).select("video", "frame", *[r6(v).alias(n) for v, n in zip(out, ("x1", "y1", "x2", "y2"), strict=True)], bx.stratum(offset, 0.1, 0.25).alias("stratum"))


@BOOK.add(
    f"""WITH {BOXES}, r AS (SELECT video, frame, x - 3 AS x, y, w, count(*) OVER (PARTITION BY video, frame // 2) AS again FROM boxes), i AS (SELECT video, frame // 2 AS frame, list_filter([CASE WHEN frame // 2 >= 3 THEN 'FRAME_BEYOND_END' END, CASE WHEN again > 1 THEN 'FRAME_DUPLICATE' END,
CASE WHEN x < 0 OR y < 0 THEN 'ORIGIN_NEGATIVE' END, CASE WHEN x + w > 120 THEN 'BEYOND_RIGHT' END, CASE WHEN y + w * 16 / 9 > 140 THEN 'BEYOND_BOTTOM' END], lambda c: c IS NOT NULL) AS f FROM r)
SELECT unnest(f) AS issue, count(*) AS n FROM i GROUP BY 1"""
)
def submission_issues(spark, d):
    rows = boxes(spark, d).select("video", F.expr("frame div 2").alias("frame"), (F.col("x") - 3).alias("x"), "y", "w", F.lit(3).alias("frames"), F.lit(120).alias("width"), F.lit(140).alias("height"))
    found = rec.issues(rows, "video", "frame", "frames", "width", "height", (9, 16))
    return found.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add(f"WITH {BOXES} SELECT video AS video_id, array_to_string(list(concat(frame, ':', CAST(x AS BIGINT), ',', CAST(y AS BIGINT), ',', CAST(w AS BIGINT)) ORDER BY frame, x, y, w), ';') AS predictions FROM boxes GROUP BY video")
def submission_records(spark, d):
    out = rec.submission(boxes(spark, d), "video", "frame", ["x", "y", "w"], (9, 16))
    return out.select("video_id", F.array_join(F.transform("predictions", lambda p: F.concat(p["frame"].cast("string"), F.lit(":"), F.array_join(p["bboxes"].cast("array<string>"), ","))), ";").alias("predictions"))


_RESPONSE = """CASE WHEN event_id % 5 = 0 THEN '{"has_highlight": false, "segments": []}' WHEN event_id % 5 = 1 THEN '{"has_highlight": true, "segments": [' WHEN event_id % 5 = 2 THEN 'no highlight'
ELSE concat('```json {"has_highlight": true, "segments": [{"start_sec": ', event_id % 40, ', "end_sec": ', event_id % 40 + 7, ', "score": 0.5, "reason": "r"}]} ```') END"""


@BOOK.add(
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'empty' WHEN event_id % 5 = 1 THEN 'truncated' WHEN event_id % 5 = 2 THEN 'malformed' WHEN event_id % 40 >= 30 THEN 'invalid' ELSE 'ok' END AS status,
CAST(CASE WHEN event_id % 5 >= 3 AND event_id % 40 < 30 THEN 25 * (event_id % 9) + event_id % 40 END AS DOUBLE) AS s, CAST(CASE WHEN event_id % 5 >= 3 AND event_id % 40 < 30 THEN 25 * (event_id % 9) + least(event_id % 40 + 7, 30) END AS DOUBLE) AS e FROM events"""
)
def response_contract(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(_RESPONSE).alias("response"), (F.col("event_id") % 9 * 25).cast("double").alias("chunk"), F.lit(30.0).alias("duration"))
    out = rec.parse_segments(rows, "chunk", "response", "duration")
    return out.select("event_id", "status", F.col("segments")[0]["start_sec"].alias("s"), F.col("segments")[0]["end_sec"].alias("e"))


@BOOK.add("SELECT event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_field(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add(
    """WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat(p_size * 1000, '/', 1001) WHEN p_partkey % 3 = 1 THEN CAST(p_size AS VARCHAR) ELSE concat(p_size, '/0') END AS r, p_retailprice AS v FROM part)
SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN try_cast(split_part(r, '/', 1) AS DOUBLE) / 1001 WHEN p_partkey % 3 = 1 THEN try_cast(r AS DOUBLE) END, 6) AS rate, try_cast(r AS DOUBLE) AS plain,
CASE WHEN v < 1000 THEN '[-inf,1000)' WHEN v < 1500 THEN '[1000,1500)' ELSE '[1500,inf)' END AS bucket FROM x"""
)
def lenient_scalars(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 3 == 0, F.concat((size * 1000).cast("string"), F.lit("/1001"))).when(k % 3 == 1, size.cast("string")).otherwise(F.concat(size.cast("string"), F.lit("/0")))
    rows = table(spark, d, "part").select("p_partkey", text.alias("r"), F.col("p_retailprice").alias("v"))
    return rows.select("p_partkey", r6(parse_rate(F.col("r")).cast("double")).alias("rate"), lenient_double(F.col("r")).alias("plain"), bucket_label(F.col("v"), [1000.0, 1500.0]).alias("bucket"))


@BOOK.add(
    f"""WITH {EV}, m AS (SELECT avg(value) AS mean_value, count(DISTINCT user_id) AS users, max(value) AS top FROM ev)
SELECT unnest(['mean', 'users', 'top']) AS rule, round(unnest([mean_value, users, top]), 6) AS value, unnest([40.0, 100.0, 400.0]) AS bound, unnest([mean_value >= 40, users >= 100, top <= 400]) AS passed FROM m"""
)
def threshold_gate(spark, d):
    row = events(spark, d).agg(F.avg("value").alias("mean_value"), F.countDistinct("user_id").alias("users"), F.max("value").alias("top"))
    return mt.gate(row, [("mean", "mean_value", "min", 40), ("users", "users", "min", 100), ("top", "top", "max", 400)]).withColumn("value", r6("value"))


@BOOK.add(f"WITH {EV} SELECT user_id, CASE WHEN avg(value) > 60 AND count(*) > 60 THEN 'A' WHEN avg(value) > 50 THEN 'B' WHEN max(value) > 300 THEN 'C' ELSE 'D' END AS verdict FROM ev GROUP BY user_id")
def verdicts(spark, d):
    e = events(spark, d).groupBy("user_id").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return e.select("user_id", mt.verdict(((F.col("m") > 60) & (F.col("n") > 60), "A"), (F.col("m") > 50, "B"), (F.col("top") > 300, "C"), otherwise="D").alias("verdict"))


@BOOK.add(f"WITH {EV} SELECT user_id, event_id, value FROM ev WHERE kind = 'view' UNION ALL SELECT user_id, event_id, value FROM ev WHERE kind = 'purchase' AND user_id NOT IN (SELECT user_id FROM ev WHERE kind = 'view' AND user_id IS NOT NULL)")
def manifest_upsert(spark, d):
    e = events(spark, d)
    side = lambda kind: e.where(F.col("kind") == kind).select("user_id", "event_id", "value")
    return rec.merge_manifest(side("purchase"), side("view"), ["user_id"])


@BOOK.add(f"WITH {EV} SELECT event_id FROM ev WHERE event_id NOT IN (SELECT event_id FROM ev WHERE kind IN ('view', 'click'))")
def resume_pending(spark, d):
    e = events(spark, d).select("event_id", "kind")
    return rec.not_done(e, e.where("kind in ('view', 'click')"), ["event_id"]).select("event_id")
