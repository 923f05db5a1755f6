"""Stores, nested records, pools, region masks, cluster bootstraps and padded batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bootstrap as bo
from ..operators import nested, pools, regions, sequences, sequences_padded
from ..operators import selection as se
from ..sources import manifests, ragged, records, shards, submissions
from .book import Book
from .tables import BOXES, EV, boxes, events, r6, table

BOOK = Book()


def _fresh(spark) -> str:
    return f"{shards.shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"


@BOOK.add("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def shard_store(spark, d):
    """Events as shards by user: one attempt is killed before it publishes, one writes the users who bought something, one resumes for the rest."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    store = shards.ShardStore(spark, _fresh(spark), "user_id", {"table": "events", "columns": rows.columns})
    store.bind()
    store.stage(rows, "killed")
    store.write(rows.join(rows.where("event_type = 'purchase'").select("user_id").distinct(), "user_id", "left_semi"))
    store.write(rows)
    store.sweep()
    return store.read().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@BOOK.add("SELECT l_suppkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1) GROUP BY l_suppkey")
def subset_reads(spark, d):
    """Lines of the suppliers of a region, from a table with a folder for each supplier, or for those of one hash where there are many: only folders with some of theirs are opened."""
    path = _fresh(spark)
    shards.write_partitioned(table(spark, d, "lineitem").select("l_suppkey", "l_quantity"), path, "l_suppkey")
    nations = table(spark, d, "nation").where("n_regionkey = 1")
    wanted = table(spark, d, "supplier").join(F.broadcast(nations), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"))  # a fixed table of nations
    rows = shards.read_subset(spark, path, wanted, "l_suppkey", strict=False)
    return rows.groupBy(F.col("l_suppkey").cast("long").alias("l_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@BOOK.add(
    f"""WITH {BOXES}, s AS (SELECT boxes.*, l.l_suppkey AS supplier, l.l_orderkey AS o FROM boxes JOIN lineitem AS l ON l.l_orderkey = boxes.video AND l.l_linenumber = boxes.frame)
SELECT CAST(supplier AS VARCHAR) AS video, count(DISTINCT o) AS frames, count(*) AS boxes, CAST(sum(w * h) AS BIGINT) AS area, round(max(score), 4) AS best FROM s GROUP BY supplier"""
)
def ragged_detections(spark, d):
    """Boxes of each supplier's orders, written as binary files of ragged arrays and read by the data source."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("video"), F.col("l_linenumber").cast("bigint").alias("frame"), "l_suppkey")
    b = boxes(spark, d).join(line, ["video", "frame"])
    box = F.array(*[c.cast("float") for c in (F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))])
    item = F.array_sort(F.collect_list(F.struct(F.col("frame").cast("int").alias("label"), box.alias("box"), F.col("score").cast("float").alias("score"))))
    rows = b.groupBy(F.col("l_suppkey").cast("string").alias("of"), F.col("video").alias("order")).agg(item.alias("x"))
    rows = rows.select(F.col("of").alias("video"), F.col("order").alias("frame"), F.col("x.box").alias("boxes"), F.col("x.score").alias("scores"), F.col("x.label").alias("labels"))
    path = _fresh(spark)
    ragged.save_ragged(rows, path)
    back = ragged.read_ragged(spark, path)
    area = F.aggregate("boxes", F.lit(0.0), lambda a, x: a + ((x[2] - x[0]) * (x[3] - x[1])).cast("double"))
    return back.groupBy("video").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.size("boxes")).alias("boxes"), F.sum(area).cast("long").alias("area"), F.round(F.max(F.array_max("scores")).cast("double"), 4).alias("best"))


#: A deny-list over orders as nested records.
_WORDS, _KEY_PARTS, _TEXT_PARTS = ["r"], ["tax"], ["urgent", "special"]


@BOOK.add(
    """WITH l AS (SELECT l_orderkey, list({'place': {'flag': l_returnflag, 'status': l_linestatus}, 'amounts': [json_object('taxRate', l_tax), json_object('rebate', l_discount)]} ORDER BY l_linenumber, l_partkey, l_extendedprice) AS lines FROM lineitem GROUP BY l_orderkey),
j AS (SELECT o_orderkey, to_json({'priority': o_orderpriority, 'lines': lines, 'r': {'total': o_totalprice}}) AS j FROM orders JOIN l ON l_orderkey = o_orderkey),
t AS (SELECT o_orderkey, fullkey AS path, lower(CASE WHEN fullkey NOT LIKE '%]' THEN key END) AS k, lower(CASE WHEN type = 'VARCHAR' THEN json_extract_string(atom, '$') END) AS v FROM j, json_tree(j.j))
SELECT o_orderkey, path, 'key' AS what FROM t WHERE k = 'r' OR contains(k, 'tax') UNION ALL SELECT o_orderkey, path, 'value' FROM t WHERE v = 'r' OR contains(v, 'urgent') OR contains(v, 'special')"""
)
def nested_denials(spark, d):
    """What a deny-list of keys and values finds at any depth of orders as JSON, with its path."""
    amounts = F.array(F.struct(F.col("l_tax").alias("taxRate"), F.lit(None).cast("double").alias("rebate")), F.struct(F.lit(None).cast("double").alias("taxRate"), F.col("l_discount").alias("rebate")))
    item = F.struct("l_linenumber", "l_partkey", "l_extendedprice", F.struct(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).alias("place"), amounts.alias("amounts")).alias("line"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("x.line").alias("lines"))
    orders = table(spark, d, "orders").join(lines, "o_orderkey")
    text = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), "lines", F.struct(F.col("o_totalprice").alias("total")).alias("r")))
    return nested.denied(orders.select("o_orderkey", text.alias("j")), ["o_orderkey"], "j", _WORDS, _KEY_PARTS, _TEXT_PARTS)


@BOOK.add()
def relaxed_pool(spark, d):
    """A quarter of all orders, by priority, at most three of a customer until a priority falls short; held against a plain loop in the tests."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", se.hash_key(F.lit(7), F.col("o_orderkey")).alias("h"))
    wanted = pools.shares(orders.count() // 4, {"1-URGENT": 0.4, "2-HIGH": 0.3, "3-MEDIUM": 0.2, "5-LOW": 0.1})
    return pools.build_pool(orders, "o_orderkey", "o_orderpriority", "o_custkey", "h", wanted, 3)


_HALF_DAY = 43_200_000_000
_FRAMES = f"""{EV}, f AS (SELECT user_id, t // {_HALF_DAY} AS frame, max(CAST(round(score * 1000000) AS BIGINT)) AS score, min(event_id) AS tie FROM ev GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY user_id) * 3 // 10 AS k FROM f)"""
_RUNS = "{0}_g AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS g FROM {0}), {0}_r AS (SELECT *, min(frame) OVER (PARTITION BY user_id, g) AS run, count(*) OVER (PARTITION BY user_id, g) AS len FROM {0}_g)"


def _frames(spark, d):
    f = events(spark, d).groupBy("user_id", F.expr(f"t div {_HALF_DAY}").alias("frame")).agg(F.max(F.round(F.col("score") * 1000000).cast("long")).alias("score"), F.min("event_id").alias("tie"))
    sizes = f.groupBy("user_id").agg(F.expr("count(1) * 3 div 10").alias("budget"))
    return f.join(sizes, "user_id")


@BOOK.add(
    f"""WITH {_FRAMES}, r AS (SELECT k.*, frame // 3 - o AS region FROM k, (VALUES (0), (1)) AS x(o)), u AS (SELECT user_id, region, row_number() OVER (PARTITION BY user_id ORDER BY sum(score) / count(*), min(tie), region) AS o FROM r GROUP BY user_id, region),
w AS (SELECT r.user_id, r.frame, min(u.o) AS o, max(r.k) AS k FROM r JOIN u USING (user_id, region) GROUP BY ALL), s AS (SELECT user_id, o, count(*) AS new FROM w GROUP BY ALL), b AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY user_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
p AS (SELECT w.user_id, w.frame, w.k - b.before AS rest, b.new FROM w JOIN b USING (user_id, o) WHERE b.before < w.k), part AS (SELECT * FROM p WHERE new > rest), {_RUNS.format('part')},
runs AS (SELECT user_id, run, len, max(rest) AS rest FROM part_r GROUP BY ALL), t AS (SELECT *, greatest(least(rest - coalesce(sum(len) OVER (PARTITION BY user_id ORDER BY len DESC, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), len), 0) AS take FROM runs)
SELECT user_id, frame FROM p WHERE new <= rest UNION ALL SELECT user_id, frame FROM part_r JOIN t USING (user_id, run) WHERE frame - run >= (t.len - take) // 2 AND frame - run < (t.len - take) // 2 + take"""
)
def region_cover(spark, d):
    """Three tenths of each user's half days: overlapping stretches of three days by their mean score, the last cut around its middle."""
    f = _frames(spark, d)
    stretches = f.select("user_id", "frame", F.explode(F.array(F.expr("frame div 3"), F.expr("frame div 3") - 1)).alias("region"))
    return regions.region_mask(f, stretches, ["user_id"], "frame", "region", "score", "tie", "budget")


_DRAW = "CAST('0x' || substr(md5(concat_ws('|', CAST(user_id AS VARCHAR), CAST({0} AS VARCHAR))), 1, 8) AS BIGINT)"


@BOOK.add(
    f"""WITH {_FRAMES}, {_RUNS.format('k')}, e AS (SELECT user_id, run, len, max(k) AS k FROM k_r GROUP BY ALL HAVING max(k) > 0), o AS (SELECT *, greatest(len - k + 1, 0) AS options FROM e),
q AS (SELECT *, sum(options) OVER (PARTITION BY user_id) AS total, coalesce(sum(options) OVER (PARTITION BY user_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, k * len // sum(len) OVER (PARTITION BY user_id) AS low, k * len % sum(len) OVER (PARTITION BY user_id) AS rest FROM o),
z AS (SELECT *, low + CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY rest DESC, run) <= k - sum(low) OVER (PARTITION BY user_id) THEN 1 ELSE 0 END AS quota FROM q),
x AS (SELECT user_id, run, total > 0 AS exact, CASE WHEN total > 0 THEN {_DRAW.format('-1')} % total - before ELSE {_DRAW.format('run')} % (len - quota + 1) END AS start, CASE WHEN total > 0 THEN k ELSE quota END AS length, options FROM z)
SELECT user_id, frame, exact FROM k_r JOIN x USING (user_id, run) WHERE (NOT exact OR start >= 0 AND start < options) AND frame - run >= start AND frame - run < start + length"""
)
def random_interval(spark, d):
    """Three tenths of each user's half days as one random run, or as a random stretch of each run."""
    return regions.random_interval_mask(_frames(spark, d), ["user_id"], "frame", "budget", bo.slot_hash(F.col("user_id"), F.col("_run")))


def _weights_sql(draws: int) -> str:
    """CTEs cl (user_id, i, n) and w (draw, i, w) after ev."""
    h = "CAST('0x' || substr(md5(concat_ws('|', 'all', CAST(draw AS VARCHAR), CAST(slot AS VARCHAR))), 1, 8) AS BIGINT)"
    return f"""cl AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM ev)), sl AS (SELECT draw, unnest(range(1, n + 1)) AS slot, n FROM (SELECT max(n) AS n FROM cl), range(1, {draws + 1}) AS t(draw)),
w AS (SELECT draw, {h} * n // 4294967296 AS i, count(*) AS w FROM sl GROUP BY ALL)"""


@BOOK.add(
    f"""WITH {EV}, {_weights_sql(100)}, s AS (SELECT user_id, sum(score) AS num, count_if(kind <> 'error') AS den FROM ev GROUP BY user_id), x AS (SELECT draw, sum(w * num) / nullif(sum(w * den), 0) AS x FROM s JOIN cl USING (user_id) JOIN w USING (i) GROUP BY draw)
SELECT 'all' AS stratum, round((SELECT sum(num) / sum(den) FROM s), 6) AS ratio, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM x"""
)
def cluster_ratio(spark, d):
    """Interval of a ratio of sums with users as clusters, multinomial weights."""
    out = bo.ratio_interval(events(spark, d), "user_id", F.col("score"), (F.col("kind") != "error").cast("long"), 100)
    return out.select("stratum", *[r6(c).alias(c) for c in ("ratio", "low", "high")])


@BOOK.add(
    f"""WITH {EV}, sc AS (SELECT user_id, score, CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END AS y FROM ev), {_weights_sql(40)}, g AS (SELECT draw, score, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM sc JOIN cl USING (user_id) JOIN (SELECT * FROM w UNION ALL SELECT 0, i, 1 FROM cl) USING (i) GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (PARTITION BY draw ORDER BY score ROWS UNBOUNDED PRECEDING) AS upto FROM g), a AS (SELECT draw, sum(pos * (upto - neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS x FROM c GROUP BY draw)
SELECT 'all' AS stratum, round(max(x) FILTER (draw = 0), 6) AS auc, round(quantile_cont(x, 0.025) FILTER (draw > 0), 6) AS low, round(quantile_cont(x, 0.975) FILTER (draw > 0), 6) AS high FROM a"""
)
def kernel_auc(spark, d):
    """Interval of the pooled AUROC with users as clusters, by score: the matrix of wins between users has the square of their number."""
    rows = events(spark, d).select("user_id", "score", (F.col("kind") == "purchase").cast("int").alias("y"))
    return bo.auc_interval_by_score(rows, "user_id", "score", "y", 40).select("stratum", *[r6(c).alias(c) for c in ("auc", "low", "high")])


@BOOK.add()
def shot_summaries(spark, d):
    """Shots of stretches of embeddings, kept within 15 % of the frames; held against a plain version in the tests."""
    seq = F.concat_ws("|", F.col("label").cast("string"), F.shiftright("vec_id", 6).cast("string"))
    e = table(spark, d, "embeddings").where("embedding is not null").select(seq.alias("seq"), "vec_id", "embedding", (F.col("embedding")[0].cast("double") * F.col("embedding")[0] + 0.01).alias("score"))
    e = e.withColumn("frame", ((F.col("vec_id") % 64) * 15)).withColumn("frames", F.lit(64 * 15).cast("long"))
    return se.shot_summary(e, "seq", "vec_id", "embedding", "score", "frame", "frames", 8)


@BOOK.add(
    f"""WITH {EV}, u AS (SELECT user_id, list(CAST(round(value * 100) AS BIGINT) ORDER BY t, event_id) AS vs, count(*) AS length FROM ev GROUP BY user_id), b AS (SELECT *, greatest(8, CAST(2 ** ceil(log2(length)) AS INT)) AS bucket, sha256(concat_ws('|', 'batch', CAST(user_id AS VARCHAR))) AS h FROM u),
p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h, user_id) - 1 AS p FROM b)
SELECT bucket, p // 16 AS batch, p % 16 AS place, user_id, length, array_to_string(vs || list_transform(range(bucket - length), lambda x: -1), ',') AS cents, repeat('1', length) || repeat('0', bucket - length) AS mask FROM p"""
)
def padded_users(spark, d):
    """Each user's values in order, padded to a power of two, in batches of 16 users of about the same length."""
    e = events(spark, d).select("user_id", "t", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    out = sequences_padded.padded_batches(e, "user_id", ["t", "event_id"], {"cents": -1}, 16)
    return out.select("bucket", "batch", "place", "user_id", F.col("length").cast("long").alias("length"), F.array_join("cents", ",").alias("cents"), F.array_join(F.transform("mask", lambda m: m.cast("int")), "").alias("mask"))


@BOOK.add()
def text_vectors(spark, d):
    """Hashed character n-grams of every turn; held against a plain version in the tests."""
    return sequences_padded.text_vectors(table(spark, d, "conversations"), ["conv_id", "turn"], "text")


@BOOK.add(
    """WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_suppkey % 100 - 2 AS x, l_partkey % 100 AS y, l_quantity, l_returnflag FROM lineitem),
i AS (SELECT l_orderkey AS k, CAST(to_json(list(CASE WHEN l_partkey % 17 = 3 THEN json_object('frame', l_linenumber) WHEN l_returnflag = 'R' THEN json_object('frame', l_linenumber // 2, 'bboxes', [x, y]) WHEN l_quantity >= 45 THEN json_object('frame', l_linenumber + 0.5, 'bboxes', [x, y, l_quantity + 0.5])
ELSE json_object('frame', l_linenumber // 2, 'bboxes', [x, y, CAST(l_quantity AS BIGINT)]) END ORDER BY l_partkey, l_linenumber, l_extendedprice)) AS VARCHAR) AS ps FROM l GROUP BY 1),
t AS (SELECT o_orderkey AS line, CASE o_orderpriority WHEN '1-URGENT' THEN '{"video_id": "v' || o_orderkey || '", "predictions": ' || ps || '}' WHEN '2-HIGH' THEN '{"video_id": "v' || o_orderkey || '", "targetRatioWH": [9, 16], "predictions": ' || ps || '}'
WHEN '3-MEDIUM' THEN '{"video_id": "v' || o_orderkey || '", "targetRatioWH": [9, 0], "predictions": ' || ps WHEN '5-LOW' THEN '{"video_id": ' || o_orderkey || ', "predictions": ' || ps || '}' ELSE ps END AS j FROM orders JOIN i ON k = o_orderkey),
r AS (SELECT line, CASE WHEN json_valid(j) THEN j END AS j FROM t), v AS (SELECT line, j, json_extract_string(j, '$.video_id') AS id, CASE WHEN j IS NULL THEN 'invalid_json' WHEN json_type(j) <> 'OBJECT' THEN 'invalid_record' WHEN json_type(j, '$.video_id') <> 'VARCHAR' THEN 'missing_video_id' END AS broken FROM r),
g AS (SELECT line, j, id, json_extract(j, '$.targetRatioWH') IS NOT NULL OR id IN (SELECT 'v' || o_orderkey FROM orders WHERE o_orderstatus <> 'P') AS has FROM v WHERE broken IS NULL), p AS (SELECT line, has, unnest(json_extract(j, '$.predictions[*]')) AS p, generate_subscripts(json_extract(j, '$.predictions[*]'), 1) - 1 AS place FROM g),
q AS (SELECT *, CASE WHEN json_type(p, '$.frame') LIKE '%BIGINT' THEN CAST(p->>'$.frame' AS BIGINT) END AS n, json_extract(p, '$.bboxes') AS b FROM p), f AS (SELECT *, CASE WHEN n < 3 THEN n END AS f FROM q),
w AS (SELECT *, last_value(f IGNORE NULLS) OVER (PARTITION BY line ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY line, f ORDER BY place) AS nth, json_array_length(b) = 3 AS three, CAST(b->>'$[0]' AS DOUBLE) AS x, CAST(b->>'$[1]' AS DOUBLE) AS y, CAST(b->>'$[2]' AS DOUBLE) AS w FROM f),
z AS (SELECT *, coalesce(three, false) AND w = floor(w) AND coalesce(json_type(b, '$[2]') LIKE '%BIGINT', false) AS ints FROM w), c AS (SELECT line, list_filter([CASE WHEN n IS NULL THEN 'non_integer_frame' END, CASE WHEN n >= 3 THEN 'frame_out_of_range' END, CASE WHEN f IS NOT NULL AND nth > 1 THEN 'duplicate_frame' END, CASE WHEN f < before THEN 'non_ascending_order' END,
CASE WHEN f = 1 THEN 'temporal_traceability_violation' END, CASE WHEN b IS NULL THEN 'missing_bboxes' END, CASE WHEN b IS NOT NULL AND NOT three THEN 'invalid_bbox_shape' END, CASE WHEN three AND NOT ints THEN 'non_integer_bbox' END, CASE WHEN ints AND (x < 0 OR y < 0 OR w <= 0) THEN 'invalid_bbox_value' END,
CASE WHEN ints AND x >= 0 AND x + w > 120 THEN 'bbox_out_of_bounds' END, CASE WHEN ints AND has AND x >= 0 AND w * 16 > (140 - y) * 9 THEN 'ratio_height_violation' END], lambda s: s IS NOT NULL) AS codes FROM z)
SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM c UNION ALL SELECT broken FROM v WHERE broken IS NOT NULL UNION ALL SELECT 'unknown_video_id' FROM g WHERE NOT EXISTS (SELECT 1 FROM orders WHERE 'v' || o_orderkey = g.id AND o_orderstatus <> 'P')
UNION ALL SELECT 'missing_video_line' FROM orders WHERE o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM g WHERE g.id = 'v' || o_orderkey)) GROUP BY code"""
)
def submission_codes(spark, d):
    """Issue codes of a submission with a line for each order, whose predictions are its lines: parsed, checked against index, sizes and frames."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", (F.col("l_suppkey") % 100 - 2).alias("x"), (F.col("l_partkey") % 100).alias("y"), "l_quantity", "l_returnflag")
    of = lambda frame, *box: F.concat(F.lit('{"frame": '), frame.cast("string"), *([F.lit(', "bboxes": ['), F.concat_ws(", ", *[b.cast("string") for b in box]), F.lit("]")] if box else []), F.lit("}"))
    half, number = F.expr("l_linenumber div 2"), F.col("l_linenumber")
    item = F.when(F.col("l_partkey") % 17 == 3, of(number)).when(F.col("l_returnflag") == "R", of(half, F.col("x"), F.col("y"))).when(F.col("l_quantity") >= 45, of(number + 0.5, F.col("x"), F.col("y"), F.col("l_quantity") + 0.5)).otherwise(of(half, F.col("x"), F.col("y"), F.col("l_quantity").cast("long")))
    lists = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_linenumber", "l_extendedprice", item.alias("item")))).alias("x"))
    ps = F.concat(F.lit("["), F.array_join("x.item", ", "), F.lit("]"))
    name = F.concat(F.lit('{"video_id": "v'), F.col("o_orderkey").cast("string"), F.lit('"'))
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(name, F.lit(', "predictions": '), ps, F.lit("}"))).when(F.col("o_orderpriority") == "2-HIGH", F.concat(name, F.lit(', "targetRatioWH": [9, 16], "predictions": '), ps, F.lit("}")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(name, F.lit(', "targetRatioWH": [9, 0], "predictions": '), ps)).when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit('{"video_id": '), F.col("o_orderkey").cast("string"), F.lit(', "predictions": '), ps, F.lit("}"))).otherwise(ps)
    )
    orders = table(spark, d, "orders")
    lines = orders.join(lists, "o_orderkey").select(F.col("o_orderkey").alias("line"), text.alias("text"))
    video = orders.select(F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("video_id"), "o_orderstatus")
    index = video.where("o_orderstatus <> 'P'").select("video_id", F.array(F.lit(9), F.lit(16)).alias("ratio"))
    sizes = video.select("video_id", F.lit(120).alias("width"), F.lit(140).alias("height"), F.lit(3).alias("frame_count"))
    allowed = video.select("video_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("frame"))
    found = submissions.validate(lines, index, sizes, allowed)
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add(
    """WITH s AS (SELECT l_orderkey, string_agg('{"start_sec": ' || l_quantity || ', "end_sec": ' || (l_quantity + round(l_discount * 100)) || ', "score": ' || round(l_tax * 15, 2) || ', "reason": "' || l_linestatus || '"}', ', ' ORDER BY l_linenumber, l_partkey, l_extendedprice) AS t FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
j AS (SELECT o_orderkey, o_orderpriority AS p, '{"has_highlight": ' || CASE WHEN o_orderstatus = 'P' THEN 'false' ELSE 'true' END || ', "segments": [' || coalesce(t, '') || ']}' AS j FROM orders LEFT JOIN s ON l_orderkey = o_orderkey),
r AS (SELECT o_orderkey, CASE p WHEN '2-HIGH' THEN '```json' || chr(10) || j || chr(10) || '```' WHEN '3-MEDIUM' THEN left(j, length(j) - 1) WHEN '5-LOW' THEN p ELSE j END AS said FROM j), b AS (SELECT o_orderkey, regexp_replace(trim(said), '^```(?:json)?\\s*|\\s*```$', '', 'g') AS body FROM r),
v AS (SELECT o_orderkey, body, CASE WHEN json_valid(body) THEN body END AS j FROM b), x AS (SELECT o_orderkey, body, json_extract_string(j, '$.has_highlight') AS has, json_extract(j, '$.segments[*]') AS segs FROM v),
z AS (SELECT o_orderkey, body, has, list_transform(segs, lambda g: {'s': CAST(g->>'$.start_sec' AS DOUBLE), 'e': CAST(g->>'$.end_sec' AS DOUBLE), 'score': CAST(g->>'$.score' AS DOUBLE)}) AS segs FROM x),
y AS (SELECT o_orderkey, segs, CASE WHEN has IS NULL THEN CASE WHEN body LIKE '{%' AND body NOT LIKE '%}' THEN 'truncated' ELSE 'malformed' END WHEN has = 'false' OR len(segs) = 0 THEN 'empty' WHEN len(list_filter(segs, lambda g: NOT (g.s >= 0 AND g.s < 30 AND g.e > g.s AND g.score BETWEEN 0 AND 1))) > 0 THEN 'invalid' ELSE 'ok' END AS status FROM z)
SELECT o_orderkey, status, CASE WHEN status = 'ok' THEN len(segs) END AS segments, CASE WHEN status = 'ok' THEN round(list_sum(list_transform(segs, lambda g: least(g.e, 30) - g.s)), 6) END AS seconds FROM y"""
)
def parsed_responses(spark, d):
    """Answers made of the returned lines of an order, fenced, cut short, plain text or JSON: status of each and its clipped seconds."""
    item = F.concat(F.lit('{"start_sec": '), F.col("l_quantity"), F.lit(', "end_sec": '), F.col("l_quantity") + F.round(F.col("l_discount") * 100), F.lit(', "score": '), F.round(F.col("l_tax") * 15, 2), F.lit(', "reason": "'), F.col("l_linestatus"), F.lit('"}'))
    line = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", item.alias("item")))).alias("x"))
    orders = table(spark, d, "orders").join(line, "o_orderkey", "left")
    j = F.concat(F.lit('{"has_highlight": '), F.when(F.col("o_orderstatus") == "P", "false").otherwise("true"), F.lit(', "segments": ['), F.coalesce(F.array_join("x.item", ", "), F.lit("")), F.lit("]}"))
    p = F.col("o_orderpriority")
    said = F.when(p == "2-HIGH", F.concat(F.lit("```json\n"), F.col("j"), F.lit("\n```"))).when(p == "3-MEDIUM", F.expr("left(j, length(j) - 1)")).when(p == "5-LOW", p).otherwise(F.col("j"))
    answers = orders.withColumn("j", j).select("o_orderkey", said.alias("said"), F.lit(0.0).alias("chunk"), F.lit(30.0).alias("duration"))
    out = records.parse_segments(answers, "chunk", "said", "duration")
    seconds = F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["end_sec"] - s["start_sec"])
    return out.select("o_orderkey", "status", F.when(F.col("status") == "ok", F.size("segments")).cast("long").alias("segments"), r6(seconds).alias("seconds"))


def _crops_sql(feedback: str) -> str:
    """Rows of guarded crops of 60 x 40 in a frame of 160 x 120, every offset tried on each axis, folded row by row."""
    best = lambda c, size, most: f"(SELECT {{'l': min(q), 'h': max(q)}} FROM (SELECT q, o, max(o) OVER () AS top FROM (SELECT q, greatest(0, least(q + {size}, {c}2) - greatest(q, {c}1)) AS o FROM (SELECT unnest(range({most + 1})) AS q))) WHERE o = top)"
    prop = lambda s, size, most: f"CAST(least(greatest(floor({s} - {size} / 2), 0), {most}) AS BIGINT)"
    back = {"none": "{s}", "offset": "{s} + ({p} - {q})", "canonical": "{p} + {z} / 2"}[feedback]
    fold = lambda s, c, size, most: back.format(s=s, p=f"least(greatest({prop(s, size, most)}, g{c}.l), g{c}.h)", q=prop(s, size, most), z=float(size))
    return f"""WITH RECURSIVE {BOXES}, r AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY frame, ordinal, x, y, w, h) AS k, x AS x1, y AS y1, x + w AS x2, y + h AS y2, CASE WHEN score >= 0.1 THEN x + w / 2 END AS cx, y + h / 2 AS cy FROM boxes),
ux AS (SELECT x1, x2, {best('x', 60, 100)} AS gx FROM (SELECT DISTINCT x1, x2 FROM r)), uy AS (SELECT y1, y2, {best('y', 40, 80)} AS gy FROM (SELECT DISTINCT y1, y2 FROM r)),
f AS (SELECT r.*, gx, gy FROM r JOIN ux ON ux.x1 = r.x1 AND ux.x2 = r.x2 JOIN uy ON uy.y1 = r.y1 AND uy.y2 = r.y2),
t AS (SELECT video, k, cx AS sx, CASE WHEN cx IS NOT NULL THEN cy END AS sy, CASE WHEN cx IS NOT NULL THEN {fold('cx', 'x', 60, 100)} END AS ax, CASE WHEN cx IS NOT NULL THEN {fold('cy', 'y', 40, 80)} END AS ay FROM f WHERE k = 1 UNION ALL
SELECT video, k, sx, sy, CASE WHEN sx IS NOT NULL THEN {fold('sx', 'x', 60, 100)} END, CASE WHEN sx IS NOT NULL THEN {fold('sy', 'y', 40, 80)} END FROM (SELECT f.*, CASE WHEN t.ax IS NULL THEN f.cx ELSE t.ax + 0.5 * (f.cx - t.ax) END AS sx, CASE WHEN f.cx IS NULL THEN NULL WHEN t.ax IS NULL THEN f.cy ELSE t.ay + 0.5 * (f.cy - t.ay) END AS sy FROM t JOIN f ON f.video = t.video AND f.k = t.k + 1)),
p AS (SELECT f.*, {prop('sx', 60, 100)} AS px, {prop('sy', 40, 80)} AS py, sx FROM f JOIN t USING (video, k)), z AS (SELECT *, least(greatest(px, gx.l), gx.h) AS x, least(greatest(py, gy.l), gy.h) AS y FROM p)
SELECT video, k, CASE WHEN sx IS NOT NULL THEN x END AS x, CASE WHEN sx IS NOT NULL THEN y END AS y, CASE WHEN sx IS NOT NULL THEN CAST(x <> px OR y <> py AS INT) END AS guarded,
CASE WHEN sx IS NOT NULL THEN round(greatest(0, least(px + 60, x2) - greatest(px, x1)) * greatest(0, least(py + 40, y2) - greatest(py, y1)) / ((x2 - x1) * (y2 - y1)), 6) END AS before, CASE WHEN sx IS NOT NULL THEN round(greatest(0, least(x + 60, x2) - greatest(x, x1)) * greatest(0, least(y + 40, y2) - greatest(y, y1)) / ((x2 - x1) * (y2 - y1)), 6) END AS after FROM z"""


def _crops(spark, d, feedback):
    order = Window.partitionBy("video").orderBy("frame", "ordinal", "x", "y", "w", "h")
    b = boxes(spark, d).withColumn("k", F.row_number().over(order).cast("bigint"))
    b = b.select("video", "k", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), F.when(F.col("score") >= 0.1, F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), *[F.lit(n).alias(c) for c, n in {"fw": 160, "fh": 120, "zw": 60, "zh": 40}.items()])
    out = sequences.guarded_crops(b, ["video"], "k", ("cx", "cy"), ("x1", "y1", "x2", "y2"), ("fw", "fh"), ("zw", "zh"), 1, feedback=feedback)
    there = F.col("x").isNotNull()
    return out.select("video", "k", "x", "y", F.when(there, F.col("guarded").cast("int")).alias("guarded"), F.when(there, r6("visible_before")).alias("before"), F.when(there, r6("visible_after")).alias("after"))


@BOOK.add(_crops_sql("none"))
def crops_guarded(spark, d):
    """Smoothed crops moved on both axes to where they show most of their box."""
    return _crops(spark, d, "none")


@BOOK.add(_crops_sql("offset"))
def crops_projected(spark, d):
    """The same with the correction added to the state."""
    return _crops(spark, d, "offset")


@BOOK.add(_crops_sql("canonical"))
def crops_canonical(spark, d):
    """The same with the centre of the crop that came out as the next state."""
    return _crops(spark, d, "canonical")


@BOOK.add(
    """WITH l AS (SELECT l_orderkey, max(l_quantity) AS most, min(l_shipdate) AS first, count_if(l_returnflag = 'R') AS back FROM lineitem GROUP BY 1)
SELECT 'v' || o_orderkey AS canonical_video_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'r' || o_custkey ELSE 'v' || o_orderkey END AS realized_video_id, CASE WHEN back > 0 THEN 'o' || o_orderkey ELSE 'v' || o_orderkey END AS original_video_id,
CASE WHEN back > 1 THEN 'n' || o_orderkey END AS replacement_video_id, o_orderpriority AS category, 'raw/' || o_orderkey AS relative_path, sha256(CAST(o_orderkey AS VARCHAR)) AS sha256 FROM orders JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND o_totalprice > 100000"""
)
def candidate_join(spark, d):
    """Orders as candidates of a split: alignment, raw files and availability met by id."""
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("back"))
    o = table(spark, d, "orders").join(line, "o_orderkey").withColumn("id", F.col("o_orderkey").cast("string"))
    name = lambda letter: F.concat(F.lit(letter), F.col("id"))
    video = name("v").alias("canonical_video_id")
    aligned = o.select(video, F.when(F.col("o_orderstatus") == "F", " Train").otherwise("test").alias("official_split"), (F.col("o_totalprice") > 100000).alias("passed"), F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("r"), F.col("o_custkey").cast("string"))).alias("actual_source_id"), F.col("o_orderpriority").alias("category"))
    raw = o.select(video, F.lit("ok").alias("download_status"), F.sha2("id", 256).alias("sha256"), F.concat(F.lit("raw/"), F.col("id")).alias("relative_path"))
    seen = o.where("back > 0").select(video, name("o").alias("original_video_id"), F.when(F.col("back") > 1, name("n")).alias("replacement_video_id"))
    return manifests.split_candidates(aligned, raw, seen)


@BOOK.add(
    """WITH r AS (SELECT *, o_orderkey // 2 AS k, count(*) OVER (PARTITION BY o_orderkey // 2) AS again FROM orders), x AS (SELECT DISTINCT l_orderkey // 2 AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48)
SELECT CAST(k AS VARCHAR) AS name, 'DUPLICATE' AS code, count(*) AS n FROM r WHERE again > 1 GROUP BY 1 UNION ALL SELECT CAST(k AS VARCHAR), 'EXCLUDED', count(*) FROM r WHERE k IN (SELECT k FROM x) GROUP BY 1
UNION ALL SELECT CAST(k AS VARCHAR), 'NOT_ALLOWED', count(*) FROM r WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1
UNION ALL SELECT coalesce(p, w), 'QUOTA', coalesce(n, 0) FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1) FULL JOIN (SELECT unnest(['1-URGENT', '2-HIGH', '9-NONE']) AS w, unnest([300, 300, 5]) AS m) ON p = w WHERE coalesce(n, 0) <> coalesce(m, 0)"""
)
def manifest_rules(spark, d):
    """Orders as a manifest: keys that are there twice, excluded or not allowed, and priorities that miss their quota."""
    records = table(spark, d, "orders").withColumn("k", F.expr("o_orderkey div 2"))
    out = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 48").select(F.expr("l_orderkey div 2").alias("k"))
    return manifests.manifest_issues(records, "k", "o_orderpriority", {"1-URGENT": 300, "2-HIGH": 300, "9-NONE": 5}, out, F.col("o_orderstatus").isin("F", "O"))
