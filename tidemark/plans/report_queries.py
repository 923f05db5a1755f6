"""Manifests, cross-checks of runs, summaries for reports, lenient readers and error classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import first_match, ratio, read_intervals
from ..operators import matching as mt
from ..operators import metrics as me
from ..operators import selection as se
from .book import Book
from .tables import BOXES, EV, boxes, events, r6, table

BOOK = Book()
DAY = 86_400_000_000


@BOOK.add(
    f"""WITH {BOXES}, f AS (SELECT video, frame, CASE WHEN w * h < 100 THEN 'small' WHEN w * h < 250 THEN 'middle' ELSE 'large' END AS stratum FROM boxes)
SELECT video, count(*) AS frames, count_if(stratum = 'small') AS small, count_if(stratum = 'middle') AS middle, count_if(stratum = 'large') AS large, array_to_string(list_sort(list(DISTINCT frame)), ',') AS listed FROM f GROUP BY video"""
)
def frame_manifest(spark, d):
    area = F.col("w") * F.col("h")
    f = boxes(spark, d).select("video", "frame", F.when(area < 100, "small").when(area < 250, "middle").otherwise("large").alias("stratum"))
    some = lambda s: F.count_if(F.col("stratum") == s).alias(s)
    return f.groupBy("video").agg(F.count(F.lit(1)).alias("frames"), some("small"), some("middle"), some("large"), F.array_join(F.array_sort(F.collect_set("frame")), ",").alias("listed"))


@BOOK.add("SELECT o_orderstatus AS split, o_orderpriority AS status, count(*) AS n, count(DISTINCT o_custkey) AS sources FROM orders GROUP BY ALL")
def index_audit(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("sources"))


@BOOK.add(
    f"""WITH {BOXES}, v AS (SELECT video, least(greatest(x, 0) / 60, 1) AS seen, greatest(x + w - 90, 0) AS over FROM boxes)
SELECT count(*) AS frames, round(avg(CASE WHEN seen >= 0.5 - 1e-9 THEN 1.0 ELSE 0 END), 6) AS seen_50, round(avg(CASE WHEN seen >= 0.75 - 1e-9 THEN 1.0 ELSE 0 END), 6) AS seen_75, round(avg(CASE WHEN seen >= 1 - 1e-9 THEN 1.0 ELSE 0 END), 6) AS seen_all, count_if(over > 0) AS over_0, count_if(over > 10) AS over_10, count_if(over > 30) AS over_30 FROM v"""
)
def visibility_thresholds(spark, d):
    v = boxes(spark, d).select(F.least(F.greatest("x", F.lit(0.0)) / 60, F.lit(1.0)).alias("seen"), F.greatest(F.col("x") + F.col("w") - 90, F.lit(0.0)).alias("over"))
    share = lambda t: r6(F.avg((F.col("seen") >= t - 1e-9).cast("double")))
    return v.agg(F.count(F.lit(1)).alias("frames"), share(0.5).alias("seen_50"), share(0.75).alias("seen_75"), share(1.0).alias("seen_all"), *[F.count_if(F.col("over") > t).alias(f"over_{t}") for t in (0, 10, 30)])


@BOOK.add(
    f"""WITH {BOXES}, g AS (SELECT video, frame, count(*) AS subjects, count_if(x >= 10 AND x + w <= 90) AS held, max(CASE WHEN x >= 10 AND x + w <= 90 THEN score END) >= max(score) AS main FROM boxes GROUP BY video, frame)
SELECT CASE WHEN subjects = 1 THEN 'one' ELSE 'several' END AS kind, count(*) AS frames, round(avg(CASE WHEN held = subjects THEN 1.0 ELSE 0 END), 6) AS all_in, round(avg(CASE WHEN held > 0 THEN 1.0 ELSE 0 END), 6) AS any_in, round(avg(CASE WHEN coalesce(main, false) THEN 1.0 ELSE 0 END), 6) AS main_in FROM g GROUP BY 1"""
)
def subject_containment(spark, d):
    b = boxes(spark, d).withColumn("in", (F.col("x") >= 10) & (F.col("x") + F.col("w") <= 90))
    g = b.groupBy("video", "frame").agg(F.count(F.lit(1)).alias("subjects"), F.count_if("in").alias("held"), (F.max(F.when(F.col("in"), F.col("score"))) >= F.max("score")).alias("main"))
    share = lambda c: r6(F.avg(c.cast("double")))
    kind = F.when(F.col("subjects") == 1, "one").otherwise("several").alias("kind")
    return g.groupBy(kind).agg(F.count(F.lit(1)).alias("frames"), share(F.col("held") == F.col("subjects")).alias("all_in"), share(F.col("held") > 0).alias("any_in"), share(F.coalesce("main", F.lit(False))).alias("main_in"))


@BOOK.add("SELECT count(*) AS rows, count_if(abs(o.o_totalprice - l.total) > 1e-6) AS differing, round(max(abs(o.o_totalprice - l.total)), 2) AS most FROM orders o JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def provenance_check(spark, d):
    """A stored value against the one made anew from its rows."""
    made = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    gap = F.abs(F.col("o_totalprice") - F.col("total"))
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(made, "o_orderkey").agg(F.count(F.lit(1)).alias("rows"), F.count_if(gap > 1e-6).alias("differing"), F.round(F.max(gap), 2).alias("most"))


_LISTS = f"WITH {EV}, a AS (SELECT user_id, list(vote ORDER BY t, event_id) AS v FROM ev WHERE kind = 'view' GROUP BY 1), b AS (SELECT user_id, list(vote ORDER BY t, event_id) AS v FROM ev WHERE kind = 'click' GROUP BY 1)"


@BOOK.add(
    f"""{_LISTS}, m AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.v IS NULL THEN 'EXTRA' WHEN b.v IS NULL THEN 'MISSING' WHEN a.v = b.v THEN 'SAME' WHEN len(a.v) <> len(b.v) THEN 'LENGTH' WHEN list_sort(a.v) = list_sort(b.v) THEN 'ORDER' ELSE 'CONTENT' END AS mismatch FROM a FULL JOIN b ON a.user_id = b.user_id)
SELECT mismatch, count(*) AS n, min(user_id) AS first FROM m GROUP BY 1"""
)
def compare_sequences(spark, d):
    """Two sets of ordered lists by key: what is missing, extra, of another length, in another order, or other content."""
    e = events(spark, d)
    side = lambda kind, name: e.where(F.col("kind") == kind).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", "vote"))), lambda x: x["vote"]).alias(name))
    both = side("view", "a").join(side("click", "b"), "user_id", "full_outer")
    a, b = F.col("a"), F.col("b")
    why = F.when(a.isNull(), "EXTRA").when(b.isNull(), "MISSING").when(a == b, "SAME").when(F.size(a) != F.size(b), "LENGTH").when(F.array_sort(a) == F.array_sort(b), "ORDER").otherwise("CONTENT")
    return both.select("user_id", why.alias("mismatch")).groupBy("mismatch").agg(F.count(F.lit(1)).alias("n"), F.min("user_id").alias("first"))


@BOOK.add("SELECT n.n_nationkey, r.r_name, (n.n_nationkey * 7) % 25 AS place FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_name <> 'ASIA'")
def membership_order(spark, d):
    """Members of a role list that the index has, with their place in the list."""
    members = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"), (F.col("n_nationkey") * 7 % 25).alias("place"))
    return members.join(table(spark, d, "region").where("r_name <> 'ASIA'"), "r_regionkey").select("n_nationkey", "r_name", "place")


@BOOK.add(f"WITH {EV}, test AS (SELECT DISTINCT user_id FROM ev WHERE kind = 'error' AND value > 60) SELECT user_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, round(sum(value), 6) AS total FROM ev WHERE user_id NOT IN (SELECT user_id FROM test WHERE user_id IS NOT NULL) AND user_id IS NOT NULL GROUP BY user_id")
def train_only(spark, d):
    e = events(spark, d)
    out = e.where("user_id is not null").join(e.where("kind = 'error' and value > 60").select("user_id").distinct(), "user_id", "left_anti")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), r6(F.sum("value")).alias("total"))


@BOOK.add(
    """WITH u AS (SELECT l_orderkey AS k, l_linenumber AS i FROM lineitem), a AS (SELECT l_orderkey AS k, l_linenumber AS i FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey AS k, l_linenumber AS i FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber < 7)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM u)) AS outside, (SELECT count(*) FROM (SELECT * FROM u EXCEPT ALL (SELECT * FROM a UNION ALL SELECT * FROM b))) AS unplaced, (SELECT count(*) FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b)) AS twice"""
)
def partition_invariants(spark, d):
    """Two kept sets against their universe, as multisets, in one grouping."""
    line = table(spark, d, "lineitem")
    kept, dropped = F.col("l_returnflag") == "R", (F.col("l_returnflag") != "R") & (F.col("l_linenumber") < 7)
    n = line.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("u"), F.count_if(kept).alias("a"), F.count_if(dropped).alias("b"))
    above = lambda x: F.sum(F.greatest(x, F.lit(0)))
    return n.agg(above(F.col("a") - F.col("u")).alias("outside"), above(F.col("u") - F.col("a") - F.col("b")).alias("unplaced"), F.sum(F.least("a", "b")).alias("twice"))


@BOOK.add(
    f"""WITH {BOXES}, a AS (SELECT video, frame, x, y, w FROM boxes), b AS (SELECT video, frame, least(x, 60) AS x, y, w FROM boxes WHERE frame < 7), n AS (SELECT a.video, a.frame, a.x AS ax, a.w AS aw, b.x AS bx, b.w AS bw, b.video IS NULL AS gone FROM a LEFT JOIN b ON a.video = b.video AND a.frame = b.frame)
SELECT count_if(gone) AS lost_frames, count_if(NOT gone AND aw <> bw) AS other_width, count_if(NOT gone AND ax <> bx) AS moved FROM n"""
)
def ablation_invariants(spark, d):
    a = boxes(spark, d).select("video", "frame", F.col("x").alias("ax"), F.col("w").alias("aw"))
    b = boxes(spark, d).where("frame < 7").select("video", "frame", F.least("x", F.lit(60.0)).alias("bx"), F.col("w").alias("bw"), F.lit(True).alias("there"))
    n = a.join(b, ["video", "frame"], "left")
    return n.agg(F.count_if(F.col("there").isNull()).alias("lost_frames"), F.count_if(F.col("there") & (F.col("aw") != F.col("bw"))).alias("other_width"), F.count_if(F.col("there") & (F.col("ax") != F.col("bx"))).alias("moved"))


@BOOK.add(f"WITH {EV}, r AS (SELECT user_id FROM ev GROUP BY user_id HAVING count_if(kind = 'signup' AND value > 40) = 0), p AS (SELECT user_id, count(*) AS before, count_if(score >= 0.3) AS after FROM ev GROUP BY user_id) SELECT count(*) AS users, CAST(coalesce(sum(before), 0) AS BIGINT) AS before, CAST(coalesce(sum(after), 0) AS BIGINT) AS after, CAST(coalesce(count_if(after = 0), 0) AS BIGINT) AS emptied FROM p JOIN r USING (user_id)")
def empty_reference(spark, d):
    """Predictions before and after selection where the reference is empty."""
    p = events(spark, d).where("user_id is not null").groupBy("user_id").agg(F.count_if((F.col("kind") == "signup") & (F.col("value") > 40)).alias("reference"), F.count(F.lit(1)).alias("before"), F.count_if(F.col("score") >= 0.3).alias("after")).where("reference = 0")
    return p.agg(F.count(F.lit(1)).alias("users"), F.coalesce(F.sum("before"), F.lit(0)).alias("before"), F.coalesce(F.sum("after"), F.lit(0)).alias("after"), F.count_if(F.col("after") == 0).alias("emptied"))


@BOOK.add("SELECT count(*) AS pairs, count(DISTINCT l_partkey) AS lefts, count(DISTINCT l_suppkey) AS rights, count(*) = count(DISTINCT l_partkey) AND count(*) = count(DISTINCT l_suppkey) AS one_to_one, count_if(l_partkey < 1 OR l_suppkey < 1) AS out_of_range FROM lineitem")
def pair_audit(spark, d):
    line = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    out = line.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("l_partkey").alias("lefts"), F.countDistinct("l_suppkey").alias("rights"), F.count_if((F.col("l_partkey") < 1) | (F.col("l_suppkey") < 1)).alias("out_of_range"))
    return out.withColumn("one_to_one", (F.col("pairs") == F.col("lefts")) & (F.col("pairs") == F.col("rights")))


@BOOK.add(f"WITH {EV} SELECT kind AS stage, count(*) AS n, round(sum(value), 6) AS wall, round(count(*) / sum(value), 6) AS throughput, round(100 * sum(value) / (SELECT sum(value) FROM ev), 6) AS percent FROM ev GROUP BY kind")
def stage_profile(spark, d):
    s = events(spark, d).groupBy(F.col("kind").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("wall"))
    whole = F.sum("wall").over(Window.partitionBy())  # a row for each stage
    return s.select("stage", "n", r6("wall").alias("wall"), r6(F.col("n") / F.col("wall")).alias("throughput"), r6(100 * F.col("wall") / whole).alias("percent"))


@BOOK.add(f"WITH {EV}, k AS (SELECT user_id, concat(kind, '_sum') AS name, sum(value) AS v FROM ev GROUP BY ALL UNION ALL SELECT user_id, concat(kind, '_count'), count(*) FROM ev GROUP BY ALL) SELECT user_id, round(max(v) FILTER (name = 'view_sum') / nullif(max(v) FILTER (name = 'view_count'), 0), 6) AS view, round(max(v) FILTER (name = 'click_sum') / nullif(max(v) FILTER (name = 'click_count'), 0), 6) AS click, CAST(sum(v) FILTER (name LIKE '%_count') AS BIGINT) AS requests FROM k GROUP BY user_id")
def request_means(spark, d):
    """Counters in long form (name, value) to means by pivot."""
    e = events(spark, d)
    long = e.groupBy("user_id", F.concat("kind", F.lit("_sum")).alias("name")).agg(F.sum("value").alias("v")).unionAll(e.groupBy("user_id", F.concat("kind", F.lit("_count"))).agg(F.count(F.lit(1)).cast("double")))
    names = [f"{k}_{x}" for k in ("click", "error", "purchase", "signup", "view") for x in ("sum", "count")]
    wide = long.groupBy("user_id").pivot("name", names).agg(F.max("v"))
    total = sum((F.coalesce(n, F.lit(0.0)) for n in names if n.endswith("count")), F.lit(0.0))
    return wide.select("user_id", r6(ratio(F.col("view_sum"), F.col("view_count"))).alias("view"), r6(ratio(F.col("click_sum"), F.col("click_count"))).alias("click"), total.cast("bigint").alias("requests"))


@BOOK.add(
    """WITH l AS (SELECT l_orderkey, count(*) AS rows, sum(l_quantity) AS q FROM lineitem GROUP BY 1), f AS (SELECT l_orderkey, count_if(l_returnflag = 'A') AS a, count_if(l_returnflag = 'N') AS n, count_if(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT o.o_orderkey, coalesce(l.rows, 0) AS rows, coalesce(f.a, 0) AS a, coalesce(f.n, 0) AS n, coalesce(f.r, 0) AS r, l.rows IS NULL AS empty, round(l.q, 2) AS quantity FROM orders o LEFT JOIN l ON l.l_orderkey = o.o_orderkey LEFT JOIN f ON f.l_orderkey = o.o_orderkey"""
)
def wide_report(spark, d):
    """A row for each order with its counts by label, those without lines too; one grouping feeds all columns."""
    line = table(spark, d, "lineitem")
    flag = lambda f: F.count_if(F.col("l_returnflag") == f).alias(f.lower())
    rows = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"), flag("A"), flag("N"), flag("R"))
    out = table(spark, d, "orders").select("o_orderkey").join(rows, "o_orderkey", "left")
    return out.select("o_orderkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "a", "n", "r")], F.col("rows").isNull().alias("empty"), "quantity")


@BOOK.add("SELECT role, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS characters, max(length(text)) AS longest, count_if(text IS NULL OR length(text) = 0) AS blank, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def response_lengths(spark, d):
    n = F.length("text")
    return table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.sum(n).alias("characters"), F.max(n).cast("bigint").alias("longest"), F.count_if(F.col("text").isNull() | (n == 0)).alias("blank"), F.countDistinct("conv_id").alias("conversations"))


@BOOK.add(
    f"""WITH {BOXES}, v AS (SELECT video, avg(w * h) AS area, avg(CASE WHEN x > 50 THEN 1.0 ELSE 0 END) AS right_share, count(*) AS n FROM boxes GROUP BY video)
SELECT count(*) AS videos, round(avg(area), 6) AS mean_area, round(quantile_cont(area, 0.5), 6) AS median_area, round(quantile_cont(area, 0.9), 6) AS p90_area, round(avg(right_share), 6) AS macro_right, round(sum(right_share * n) / sum(n), 6) AS micro_right FROM v"""
)
def reference_geometry(spark, d):
    """Means of video means beside means of all rows."""
    v = boxes(spark, d).groupBy("video").agg(F.avg(F.col("w") * F.col("h")).alias("area"), F.avg((F.col("x") > 50).cast("double")).alias("right_share"), F.count(F.lit(1)).alias("n"))
    q = me.quantiles(v, [], "area", {"median_area": 0.5, "p90_area": 0.9}).select(r6("median_area").alias("median_area"), r6("p90_area").alias("p90_area"))
    return q.crossJoin(v.agg(F.count(F.lit(1)).alias("videos"), r6(F.avg("area")).alias("mean_area"), r6(F.avg("right_share")).alias("macro_right"), r6(F.sum(F.col("right_share") * F.col("n")) / F.sum("n")).alias("micro_right")))  # one row each


@BOOK.add(f"WITH {EV}, m AS (SELECT *, max(score) OVER (PARTITION BY user_id) AS peak FROM ev) SELECT event_id, round(score / nullif(peak, 0), 6) AS by_peak, CASE WHEN score > 0.3 THEN 1 ELSE 0 END AS indicator, round(CASE WHEN vote >= 3 THEN score ELSE 0 END, 6) AS masked FROM m")
def support_fallback(spark, d):
    """A support ratio as a share of its key's peak, as an indicator, and under a mask."""
    peak = F.max("score").over(Window.partitionBy("user_id"))
    return events(spark, d).select("event_id", r6(ratio(F.col("score"), peak)).alias("by_peak"), (F.col("score") > 0.3).cast("int").alias("indicator"), r6(F.when(F.col("vote") >= 3, F.col("score")).otherwise(0.0)).alias("masked"))


@BOOK.add(f"WITH {EV} SELECT user_id, count(*) AS rows, count_if(vote <> 0) AS used, round(avg(score) FILTER (vote <> 0), 6) AS masked_mean, round(sum(score) FILTER (vote <> 0) / count(*), 6) AS padded_mean FROM ev GROUP BY user_id")
def masked_means(spark, d):
    used = F.col("vote") != 0
    return events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(used).alias("used"), r6(F.avg(F.when(used, F.col("score")))).alias("masked_mean"), r6(F.sum(F.when(used, F.col("score"))) / F.count(F.lit(1))).alias("padded_mean"))


@BOOK.add(
    f"""WITH {EV}, s AS (SELECT event_id, kind, row_number() OVER (PARTITION BY kind ORDER BY event_id) AS i, row_number() OVER (PARTITION BY kind ORDER BY md5(concat('shuffle|', event_id)), event_id) AS j, vote FROM ev) SELECT a.event_id, a.kind, b.vote FROM s a JOIN s b ON a.kind = b.kind AND a.i = b.j"""
)
def shuffle_in_split(spark, d):
    """Values dealt anew within each split, in hash order: a negative control that no partition changes."""
    e = events(spark, d).select("event_id", "kind", "vote")
    ends = e.agg(F.min("event_id").alias("_lo"), (F.max("event_id") + 1).alias("_hi"))
    spread = e.crossJoin(F.broadcast(ends)).withColumn("_part", F.expr("width_bucket(event_id, _lo, _hi, 1024)")).drop("_lo", "_hi")  # one row
    placed = se.numbered(spread, ["kind"], ["event_id"], F.col("_part"), "i")
    hashed = e.withColumn("h", F.md5(F.concat(F.lit("shuffle|"), F.col("event_id").cast("string"))))
    dealt = se.numbered(hashed, ["kind"], ["h", "event_id"], F.substring("h", 1, 3), "i")
    return placed.select("event_id", "kind", "i").join(dealt.select("kind", "i", F.col("vote")), ["kind", "i"]).select("event_id", "kind", "vote")


# Words of messages and the class that each stands for, the first that matches.
_ERRORS = [("timed? ?out|timeout", "timeout"), ("not found|404|missing", "not_found"), ("memory|cuda", "out_of_memory"), ("denied|forbidden|403", "forbidden"), ("corrupt|invalid data|moov", "damaged")]


@BOOK.add(
    """WITH m AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Read timed out' WHEN 1 THEN 'HTTP 404' WHEN 2 THEN 'CUDA out of memory' WHEN 3 THEN 'Access denied' WHEN 4 THEN 'moov atom missing' WHEN 5 THEN 'unknown' END AS said FROM events),
c AS (SELECT *, CASE WHEN regexp_matches(lower(said), 'timed? ?out|timeout') THEN 'timeout' WHEN regexp_matches(lower(said), 'not found|404|missing') THEN 'not_found' WHEN regexp_matches(lower(said), 'memory|cuda') THEN 'out_of_memory' WHEN regexp_matches(lower(said), 'denied|forbidden|403') THEN 'forbidden' WHEN regexp_matches(lower(said), 'corrupt|invalid data|moov') THEN 'damaged' ELSE 'other' END AS class FROM m)
SELECT class, class IN ('timeout', 'out_of_memory') AS temporary, count(*) AS n FROM c GROUP BY ALL"""
)
def error_classes(spark, d):
    texts = ["Read timed out", "HTTP 404", "CUDA out of memory", "Access denied", "moov atom missing", "unknown"]
    said = F.get(F.array(*map(F.lit, texts)), (F.col("event_id") % 7).cast("int"))
    m = table(spark, d, "events").select(first_match(F.lower(said), _ERRORS, "other").alias("class"))
    return m.groupBy("class").agg(F.count(F.lit(1)).alias("n")).withColumn("temporary", F.col("class").isin("timeout", "out_of_memory"))


_PARTS = """WITH s AS (SELECT user_id, string_agg(concat(CAST(value AS INT), '-', CASE WHEN event_id % 9 = 0 THEN 'x' ELSE CAST(CAST(value AS INT) + vote AS VARCHAR) END), '; ' ORDER BY t, event_id) AS text FROM ev GROUP BY user_id),
p AS (SELECT user_id, trim(unnest(string_split(text, ';'))) AS part FROM s), i AS (SELECT user_id, try_cast(split_part(part, '-', 1) AS INT) AS a, try_cast(split_part(part, '-', 2) AS INT) AS b FROM p)"""


@BOOK.add(f"WITH {EV}, {_PARTS.removeprefix('WITH ')} SELECT user_id, count(*) AS parts, count_if(a IS NULL OR b IS NULL OR b <= a) AS bad, CAST(coalesce(sum(b - a) FILTER (b > a), 0) AS BIGINT) AS covered FROM i GROUP BY user_id")
def interval_text(spark, d):
    """Texts like '3-5; 7-x' to intervals; parts that are no interval of positive length are counted, not guessed."""
    value = F.round("value").cast("int").cast("string")
    end = F.when(F.col("event_id") % 9 == 0, "x").otherwise((F.round("value").cast("int") + F.col("vote")).cast("string"))
    s = events(spark, d).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", F.concat(value, F.lit("-"), end).alias("p")))), lambda x: x["p"]), "; ").alias("text"))
    p = s.select("user_id", F.explode(read_intervals(F.col("text"))).alias("x"))
    good = F.coalesce(F.col("x.b") > F.col("x.a"), F.lit(False))
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("parts"), F.count_if(~good).alias("bad"), F.coalesce(F.sum(F.when(good, F.col("x.b") - F.col("x.a"))), F.lit(0)).cast("bigint").alias("covered"))


@BOOK.add(
    """WITH o AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS i, count(*) OVER () AS n FROM part), t AS (SELECT *, least(i * 3 // n, 2) AS tercile FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY tercile ORDER BY sha256(concat('pick|', p_partkey))) AS place FROM t) SELECT p_partkey, CAST(tercile AS BIGINT) AS tercile FROM k WHERE place <= 5"""
)
def tercile_picks(spark, d):
    """Five of each third by size, in hash order; thirds by place, numbered without one task for all rows."""
    part = table(spark, d, "part").select("p_partkey", "p_size")
    ends = part.agg(F.min("p_partkey").alias("_lo"), (F.max("p_partkey") + 1).alias("_hi"))
    part = part.crossJoin(F.broadcast(ends)).withColumn("_part", F.expr("width_bucket(p_partkey, _lo, _hi, 64)")).drop("_lo", "_hi")  # one row
    p = se.numbered(part, [], ["p_size", "p_partkey"], F.struct("p_size", "_part"), "place", "n")
    t = p.select("p_partkey", F.least(F.expr("(place - 1) * 3 div n"), F.lit(2)).cast("bigint").alias("tercile"))
    return se.quota(t, ["tercile"], 5, F.lit("pick"), F.col("p_partkey")).select("p_partkey", "tercile")


@BOOK.add(
    """WITH c AS (SELECT c_custkey, c_acctbal FROM customer), o AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1), x AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')
SELECT CASE WHEN x.o_custkey IS NOT NULL THEN 'EXCLUDED' WHEN o.n IS NULL THEN 'UNAVAILABLE' WHEN c_acctbal < 0 THEN 'ALIGNMENT_FAILED' WHEN o.n >= 15 THEN 'FROZEN' ELSE 'CANDIDATE' END AS bucket, count(*) AS n FROM c LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN x ON x.o_custkey = c_custkey GROUP BY 1"""
)
def candidate_buckets(spark, d):
    """The first bucket that holds, by lookups in several tables made in one grouping."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("o_orderstatus") == "P").alias("x"))
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal").join(o, "c_custkey", "left")
    bucket = mt.verdict((F.coalesce("x", F.lit(False)), "EXCLUDED"), (F.col("n").isNull(), "UNAVAILABLE"), (F.col("c_acctbal") < 0, "ALIGNMENT_FAILED"), (F.col("n") >= 15, "FROZEN"), otherwise="CANDIDATE")
    return c.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@BOOK.add(
    """WITH r AS (SELECT p_partkey, 1000 * (p_size + 23) AS num, CASE WHEN p_partkey % 4 = 0 THEN 1001 ELSE 1000 END AS den FROM part)
SELECT p_partkey, num // gcd(num, den) AS rate_num, den // gcd(num, den) AS rate_den, round(100 * den / num, 9) AS t100, CAST(CAST(concat('0x', substr(sha256(concat('seed|', p_partkey)), 1, 8)) AS BIGINT) % 1000003 AS BIGINT) AS seed FROM r"""
)
def rational_rates(spark, d):
    """Rates in lowest terms, the time of frame 100, and a seed that follows from the key."""
    k = F.col("p_partkey")
    num, den = 1000 * (F.col("p_size").cast("bigint") + 23), F.when(k % 4 == 0, 1001).otherwise(1000).cast("bigint")
    r = table(spark, d, "part").select("p_partkey", num.alias("num"), den.alias("den"))
    # Euclid's steps on numbers below 2^20
    pair = F.struct(F.col("num").alias("a"), F.col("den").alias("b"))
    turn = lambda x, _: F.struct(F.when(x["b"] == 0, x["a"]).otherwise(x["b"]).alias("a"), F.when(x["b"] == 0, x["b"]).otherwise(x["a"] % x["b"]).alias("b"))
    r = r.withColumn("g", F.aggregate(F.sequence(F.lit(1), F.lit(30)), pair, turn)["a"])
    seed = F.conv(F.substring(F.sha2(F.concat(F.lit("seed|"), k.cast("string")), 256), 1, 8), 16, 10).cast("bigint") % 1000003
    return r.select("p_partkey", F.expr("num div g").alias("rate_num"), F.expr("den div g").alias("rate_den"), F.round(100 * F.col("den") / F.col("num"), 9).alias("t100"), seed.alias("seed"))


@BOOK.add(
    f"""WITH {EV}, w AS (SELECT user_id, t // {10 * DAY} AS bin, avg(score) AS score, max(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) AS y FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, bin) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM w)
SELECT percent, round(avg(CASE WHEN k <= ceil(n * percent / 100) THEN y END), 6) AS top, round(avg(y), 6) AS base, round(avg(CASE WHEN k <= ceil(n * percent / 100) THEN y END) / avg(y), 6) AS enrichment FROM r, (SELECT unnest([10, 20, 30]) AS percent) GROUP BY percent"""
)
def window_enrichment(spark, d):
    """Positive windows among each user's best ones against all windows."""
    e = events(spark, d)
    w = e.groupBy("user_id", F.expr(f"t div {10 * DAY}").alias("bin")).agg(F.avg("score").alias("score"), F.max((F.col("kind") == "purchase").cast("int")).alias("y"))
    by = Window.partitionBy("user_id")
    r = w.select("y", F.row_number().over(by.orderBy(F.desc(F.round("score", 9)), "bin")).alias("k"), F.count(F.lit(1)).over(by).alias("n")).withColumn("percent", F.explode(F.array(F.lit(10), F.lit(20), F.lit(30))))
    top = F.avg(F.when(F.col("k") <= F.ceil(F.col("n") * F.col("percent") / 100), F.col("y")))
    return r.groupBy("percent").agg(r6(top).alias("top"), r6(F.avg("y")).alias("base"), r6(top / F.avg("y")).alias("enrichment"))


@BOOK.add(
    """SELECT l_orderkey, l_linenumber, o_orderstatus AS policy, c_mktsegment AS segment, n_name AS origin, round(l_extendedprice * (1 - l_discount), 6) AS net, l_quantity > 25 AS large FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"""
)
def composed_rows(spark, d):
    """A wide row for each frame: its policy, metadata and origin by equi-joins; the dimension tables are small enough for Spark to broadcast by size."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    all_ = line.join(orders, "l_orderkey").join(c, "c_custkey").join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    net = r6(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return all_.select("l_orderkey", "l_linenumber", F.col("o_orderstatus").alias("policy"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("origin"), net.alias("net"), (F.col("l_quantity") > 25).alias("large"))


@BOOK.add(
    f"""WITH {BOXES}, r AS (SELECT unnest(list_filter([CASE WHEN w * h > 250 THEN 'TOO_LARGE' END, CASE WHEN score < 0.3 THEN 'LOW_SCORE' END, CASE WHEN x + w > 100 THEN 'OUTSIDE' END], lambda c: c IS NOT NULL)) AS reason, w * h / 10000 AS share, ordinal % 3 AS class FROM boxes)
SELECT reason, count(*) AS frames, round(count(*) / (SELECT count(*) FROM boxes), 6) AS of_all, count_if(class = 0) AS class_0, count_if(class = 1) AS class_1, round(avg(share), 6) AS mean_area, round(quantile_cont(share, 0.5), 6) AS median_area FROM r GROUP BY reason"""
)
def fallback_reasons(spark, d):
    """Reasons of frames, several to a frame and each counted, with shares of all frames, classes and areas."""
    area = F.col("w") * F.col("h")
    why = F.array_compact(F.array(F.when(area > 250, "TOO_LARGE"), F.when(F.col("score") < 0.3, "LOW_SCORE"), F.when(F.col("x") + F.col("w") > 100, "OUTSIDE")))
    b = boxes(spark, d)
    r = b.select(F.explode(why).alias("reason"), (area / 10000).alias("share"), (F.col("ordinal") % 3).alias("class"))
    some = lambda k: F.count_if(F.col("class") == k).alias(f"class_{k}")
    out = r.groupBy("reason").agg(F.count(F.lit(1)).alias("frames"), some(0), some(1), r6(F.avg("share")).alias("mean_area"))
    out = out.join(me.quantiles(r, ["reason"], "share", {"median_area": 0.5}), "reason", "left").withColumn("median_area", r6("median_area"))
    return out.crossJoin(F.broadcast(b.agg(F.count(F.lit(1)).alias("n")))).withColumn("of_all", r6(F.col("frames") / F.col("n"))).drop("n")  # one row


@BOOK.add(
    f"""WITH {EV}, l AS (SELECT kind, unnest(['value', 'score', 'age']) AS feature, unnest([value, score, CAST(t AS DOUBLE) / 86400000000]) AS v, CASE WHEN vote >= 3 THEN 1.0 ELSE 0.0 END AS y FROM ev)
SELECT feature, coalesce(kind, 'pooled') AS scope, count(*) AS n, round(corr(v, y), 6) AS correlation, round(avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0), 6) AS gap FROM l GROUP BY GROUPING SETS ((feature, kind), (feature))"""
)
def signal_audit(spark, d):
    """Each feature against the label, pooled and by scope."""
    pair = lambda name, c: F.struct(F.lit(name).alias("feature"), c.cast("double").alias("v"))
    e = events(spark, d)
    long = e.select("kind", (F.col("vote") >= 3).cast("double").alias("y"), F.explode(F.array(pair("value", F.col("value")), pair("score", F.col("score")), pair("age", F.col("t").cast("double") / 86400000000))).alias("x")).select("kind", "y", "x.*")
    gap = F.avg(F.when(F.col("y") == 1, F.col("v"))) - F.avg(F.when(F.col("y") == 0, F.col("v")))
    out = long.groupingSets([["feature", "kind"], ["feature"]], "feature", "kind").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("v", "y")).alias("correlation"), r6(gap).alias("gap"))
    return out.select("feature", F.coalesce("kind", F.lit("pooled")).alias("scope"), "n", "correlation", "gap")


@BOOK.add(
    """WITH c AS (SELECT p_partkey, p_brand, p_size, p_retailprice FROM part), a AS (SELECT p_partkey, 'longest' AS arm FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM c) WHERE k <= 3), b AS (SELECT p_partkey, 'cheapest' AS arm FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM c) WHERE k <= 1)
SELECT p_partkey, array_to_string(list_sort(list(arm)), ',') AS arms FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY p_partkey"""
)
def subset_picks(spark, d):
    """Fixed picks of each brand, the three largest and the cheapest, united; each says which arms took it."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    first = lambda arm, k, *order: p.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(*order)).alias("k"), F.lit(arm).alias("arm")).where(F.col("k") <= k).select("p_partkey", "arm")
    both = first("longest", 3, F.desc("p_size"), "p_partkey").unionAll(first("cheapest", 1, "p_retailprice", "p_partkey"))
    return both.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list("arm")), ",").alias("arms"))


@BOOK.add(
    f"""WITH {EV}, i AS (SELECT user_id, event_id, t, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run, kind FROM ev), c AS (SELECT * FROM i WHERE kind <> 'error'),
s AS (SELECT user_id, run, count(*) AS n, min(t) AS begins FROM c GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, begins) AS k FROM s), o AS (SELECT c.*, b.n, row_number() OVER (PARTITION BY c.user_id, c.run ORDER BY c.t, c.event_id) - 1 AS place FROM c JOIN b ON b.user_id = c.user_id AND b.run = c.run AND b.k = 1)
SELECT event_id, user_id FROM o WHERE place >= (n - least(n, 5)) // 2 AND place < (n - least(n, 5)) // 2 + least(n, 5)"""
)
def centered_pieces(spark, d):
    """Up to five rows from the middle of each user's longest stretch without an error."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    i = events(spark, d).withColumn("run", F.sum((F.col("kind") == "error").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind <> 'error'")
    run = Window.partitionBy("user_id", "run")
    i = i.select("event_id", "user_id", "run", F.count(F.lit(1)).over(run).alias("n"), F.min("t").over(run).alias("begins"), (F.row_number().over(run.orderBy("t", "event_id")) - 1).alias("place"))
    best = F.max(F.struct("n", (-F.col("begins")).alias("b"))).over(Window.partitionBy("user_id"))
    start = F.expr("(n - least(n, 5)) div 2")
    return i.withColumn("best", best).where((F.col("n") == F.col("best.n")) & (-F.col("begins") == F.col("best.b")) & (F.col("place") >= start) & (F.col("place") < start + F.least(F.col("n"), F.lit(5)))).select("event_id", "user_id")


@BOOK.add(
    """WITH e AS (SELECT o_orderkey AS k, count(*) AS n, sum(CAST(l_linenumber AS BIGINT) * 1000003 + l_partkey) AS mark FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), p AS (SELECT l_orderkey AS k, count(*) AS n, sum(CAST(l_linenumber AS BIGINT) * 1000003 + l_partkey) AS mark FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1)
SELECT CASE WHEN p.k IS NULL THEN 'absent' WHEN p.n < e.n THEN 'short' WHEN p.mark <> e.mark THEN 'differs' ELSE 'complete' END AS state, count(*) AS shards FROM e LEFT JOIN p ON p.k = e.k GROUP BY 1"""
)
def shard_states(spark, d):
    """Shards written against what their manifest promises: rows and an order-free mark of the content."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", (F.col("l_linenumber").cast("bigint") * 1000003 + F.col("l_partkey")).alias("m"))
    done = F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz")
    e = line.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("mark"), F.count_if(done).alias("pn"), F.sum(F.when(done, F.col("m"))).alias("pmark"))
    e = e.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    state = F.when(F.col("pn") == 0, "absent").when(F.col("pn") < F.col("n"), "short").when(F.col("pmark") != F.col("mark"), "differs").otherwise("complete")
    return e.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("shards"))
