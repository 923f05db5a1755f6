"""Placement guards, gates, masks, rater votes, comparisons and identities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions.scalars import canonical_json, ratio
from ..operators import intervals as iv
from ..operators import metrics as me
from ..operators import sequences as sq
from .book import Book
from .matching_queries import _CROP, _frames
from .metric_queries import _RATES, _SC, _curve_sql, _scored
from .tables import BOXES, EV, STRETCH, boxes, events, points, r6, spans, table

BOOK = Book()
DAY = 86_400_000_000

_BOX = f"{_CROP}, b AS (SELECT *, least(cx, fw - 41) + 0.25 AS s, least(least(cx, fw - 41) + 0.25 + 20.5 * (p_partkey % 50) + 10, CAST(fw AS DOUBLE)) AS e, CAST(least(greatest(floor(fw / 2 - w / 2), 0), fw - w) AS BIGINT) AS px FROM c)"


def _subjects(spark, d):
    f = _frames(spark, d)
    x, _, w, h = bx.crop_at(F.col("fw"), F.col("fh"), 9, 16, F.col("fw") / 2, F.col("fh") / 2)
    s = F.least("cx", F.col("fw") - 41) + 0.25
    return f.select("*", w.alias("w"), h.alias("h"), x.alias("px"), s.alias("s"), F.least(s + 20.5 * (F.col("p_partkey") % 50) + 10, F.col("fw").cast("double")).alias("e"))


@BOOK.add(
    f"""{_BOX}, q AS (SELECT *, unnest(range(0, fw - w + 1)) AS q FROM b), o AS (SELECT p_partkey, q, px, w, s, e, greatest(least(q + w, e) - greatest(q, s), 0) AS o, max(greatest(least(q + w, e) - greatest(q, s), 0)) OVER (PARTITION BY p_partkey) AS most FROM q),
m AS (SELECT p_partkey, min(q) AS low, max(q) AS high, any_value(most) AS most, any_value(px) AS px, any_value(w) AS w, any_value(s) AS s, any_value(e) AS e FROM o WHERE o = most GROUP BY p_partkey),
x AS (SELECT *, least(greatest(px, low), high) AS x FROM m)
SELECT p_partkey, low, high, round(most, 6) AS overlap, most = e - s AS whole, x, x <> px AS guarded, x + w / 2 AS center, round(greatest(least(px + w, e) - greatest(px, s), 0) / (e - s), 6) AS before, round(greatest(least(x + w, e) - greatest(x, s), 0) / (e - s), 6) AS after FROM x"""
)
def placement_guard(spark, d):
    """Whole offsets of the greatest overlap in closed form; the SQL tries all of them."""
    f = _subjects(spark, d)
    low, high, most = bx.best_placements(F.col("fw"), F.col("w"), F.col("s"), F.col("e"))
    f = f.select("*", low.alias("low"), high.alias("high"), most.alias("most")).withColumn("x", F.least(F.greatest("px", "low"), F.col("high")))
    seen = lambda x: r6(F.greatest(F.least(F.col(x) + F.col("w"), F.col("e")) - F.greatest(F.col(x).cast("double"), F.col("s")), F.lit(0.0)) / (F.col("e") - F.col("s")))
    center = bx.canonical_center(F.col("x"), F.lit(0), F.col("w"), F.lit(0))[0]
    return f.select("p_partkey", "low", "high", r6("most").alias("overlap"), (F.col("most") == F.col("e") - F.col("s")).alias("whole"), "x", (F.col("x") != F.col("px")).alias("guarded"), center.alias("center"), seen("px").alias("before"), seen("x").alias("after"))


@BOOK.add(f"{_BOX}, q AS (SELECT p_partkey, s, w, unnest(range(0, fw - w + 1)) AS q FROM b) SELECT p_partkey, min(q) AS low, max(q) AS high FROM q WHERE q <= s AND s < q + w GROUP BY p_partkey")
def containing_placements(spark, d):
    low, high = bx.containing_placements(F.col("fw"), F.col("w"), F.col("s"))
    return _subjects(spark, d).select("p_partkey", low.alias("low"), high.alias("high")).where("low <= high")


@BOOK.add(
    f"""{_BOX} SELECT p_partkey, round(abs(px + w / 2 - fw / 2) / fw, 6) AS shift_x, px >= 0 AND px + w <= fw AS inside, w * 16 <= h * 9 + 16 AS ratio_ok, w = CASE WHEN fw * 16 >= fh * 9 THEN fh * 9 // 16 ELSE fw END AS width_ok,
round(greatest(least(e, fw) / fw - s / fw, 0) * 0.5, 6) AS context FROM b"""
)
def geometry_gate(spark, d):
    f = _subjects(spark, d)
    shift = bx.crop_shift(F.col("px"), F.lit(0), F.col("w"), F.col("h"), F.col("fw"), F.col("fh"))[0]
    w, _ = bx.crop_size(F.col("fw"), F.col("fh"), 9, 16)
    window = (F.col("s") / F.col("fw"), F.lit(0.25), F.least("e", F.col("fw").cast("double")) / F.col("fw"), F.lit(0.75))
    return f.select("p_partkey", r6(shift).alias("shift_x"), ((F.col("px") >= 0) & (F.col("px") + F.col("w") <= F.col("fw"))).alias("inside"), (F.col("w") * 16 <= F.col("h") * 9 + 16).alias("ratio_ok"), (F.col("w") == w).alias("width_ok"), r6(bx.context_retention(window)).alias("context"))


_RUNS = f"""{_SC}, m AS (SELECT *, CASE WHEN y = 1 AND coalesce(lag(y) OVER w, 0) = 1 THEN 0 ELSE 1 END AS new FROM sc WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m),
rn AS (SELECT user_id, run, count(*) AS n, max(score) AS top, count_if(score >= 0.4) AS kept, max(t) - min(t) AS took FROM i WHERE y = 1 GROUP BY user_id, run),
st AS (SELECT *, CASE WHEN took <= {DAY // 8} THEN 'short' WHEN took <= {DAY} THEN 'medium' ELSE 'long' END AS stratum, kept / n AS retention FROM rn)"""


def _runs(spark, d):
    """Runs of purchases of a user with their length, best score, kept rows and duration stratum."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    s = _scored(spark, d).withColumn("new", F.when((F.col("y") == 1) & (F.lag("y", 1, 0).over(w) == 1), 0).otherwise(1))
    s = s.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("y = 1")
    out = s.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), F.count_if(F.col("score") >= 0.4).alias("kept"), (F.max("t") - F.min("t")).alias("took"))
    stratum = F.when(F.col("took") <= DAY // 8, "short").when(F.col("took") <= DAY, "medium").otherwise("long")
    return out.select("*", stratum.alias("stratum"), (F.col("kept") / F.col("n")).alias("retention"))


@BOOK.add(
    f"""WITH {_RUNS} SELECT coalesce(stratum, 'overall') AS stratum, count(*) AS runs, round(count_if(kept > 0) / count(*), 6) AS survival, round(count_if(kept = 0) / count(*), 6) AS deleted, round(avg(retention), 6) AS mean, round(quantile_cont(retention, 0.5), 6) AS median,
round(quantile_cont(retention, 0.1), 6) AS p10, round(quantile_cont(retention, 0.25), 6) AS p25, min(retention) AS low FROM st GROUP BY GROUPING SETS ((stratum), ())"""
)
def run_retention_strata(spark, d):
    r = _runs(spark, d)
    both = r.withColumn("stratum", F.explode(F.array("stratum", F.lit("overall"))))
    out = both.groupBy("stratum").agg(F.count(F.lit(1)).alias("runs"), r6(F.avg((F.col("kept") > 0).cast("double"))).alias("survival"), r6(F.avg((F.col("kept") == 0).cast("double"))).alias("deleted"), r6(F.avg("retention")).alias("mean"), F.min("retention").alias("low"))
    q = me.quantiles(both, ["stratum"], "retention", {"median": 0.5, "p10": 0.1, "p25": 0.25})
    return out.join(q, "stratum", "left").select("stratum", "runs", "survival", "deleted", "mean", "low", *[r6(c).alias(c) for c in ("median", "p10", "p25")])


@BOOK.add(
    f"""{_curve_sql('')}, {_RATES}, {_RUNS.removeprefix(_SC + ', ')}, bound AS (SELECT min(top) AS bound FROM rn)
SELECT score AS tau, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(pruned, 6) AS pruned FROM f, bound WHERE r >= 0.5 - 1e-12 AND score <= bound ORDER BY round(pruned, 12) DESC, r DESC, score DESC LIMIT 1"""
)
def tau_run_safe(spark, d):
    """The threshold that prunes most among those of recall 0.5 at which no run of positives goes whole."""
    bound = _runs(spark, d).agg(F.min("top").alias("bound"))
    c = me.with_rates(me.curve(_scored(spark, d), [], "score", "y")).crossJoin(F.broadcast(bound))  # one row
    best = F.max(F.struct(F.round("pruned", 12).alias("by"), "recall", "score", "precision", "f1", "pruned")).alias("b")
    return c.where("recall >= 0.5 - 1e-12 and score <= bound").agg(best).where("b is not null").select(F.col("b.score").alias("tau"), *[r6(f"b.{k}").alias(k) for k in ("precision", "recall", "f1", "pruned")])


_ARM = f"WITH {EV}, a AS (SELECT vote AS arm, avg(score) AS recall, avg(value) AS iou, count(*) AS n, count_if(kind = 'error') AS errors FROM ev GROUP BY vote)"


@BOOK.add(f"{_ARM}, b AS (SELECT recall, errors / n AS rate FROM a WHERE arm = 0) SELECT arm, round(a.recall, 6) AS recall, round(iou, 6) AS iou, n FROM a, b WHERE a.recall >= b.recall - 0.05 AND errors / n <= b.rate + 0.05 ORDER BY round(a.recall, 9) DESC, round(iou, 9) DESC, errors, n, arm LIMIT 1")
def arm_winner(spark, d):
    """The arm that comes first by five keys among those within the guardrails of the baseline, arm 0."""
    a = events(spark, d).groupBy(F.col("vote").alias("arm")).agg(F.avg("score").alias("recall"), F.avg("value").alias("iou"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "error").alias("errors"))
    b = a.where("arm = 0").select(F.col("recall").alias("r0"), (F.col("errors") / F.col("n")).alias("e0"))
    ok = a.crossJoin(F.broadcast(b)).where((F.col("recall") >= F.col("r0") - 0.05) & (F.col("errors") / F.col("n") <= F.col("e0") + 0.05))  # one row
    best = F.max(F.struct(F.round("recall", 9).alias("a"), F.round("iou", 9).alias("b"), (-F.col("errors")).alias("c"), (-F.col("n")).alias("d"), (-F.col("arm")).alias("e"), "arm", "recall", "iou", "n")).alias("x")
    return ok.agg(best).where("x is not null").select("x.arm", r6("x.recall").alias("recall"), r6("x.iou").alias("iou"), "x.n")


_VOTES = f"""WITH {EV}, v AS (SELECT user_id, t // {20 * DAY} AS bin, vote % 3 AS rater, arg_max(CASE WHEN value BETWEEN 20 AND 30 THEN 'unsure' WHEN value > 30 THEN 'yes' ELSE 'no' END, (t, event_id)) AS v FROM ev WHERE kind <> 'error' GROUP BY ALL),
a AS (SELECT user_id, t // {20 * DAY} AS bin, arg_min(value > 30, (t, event_id)) AS fourth FROM ev WHERE kind = 'error' GROUP BY ALL),
b AS (SELECT user_id, bin, count_if(v = 'yes') AS yes, count_if(v = 'no') AS no, count_if(v = 'unsure') AS unsure FROM v GROUP BY ALL HAVING count(*) = 3),
r AS (SELECT b.*, yes = 3 OR no = 3 AS agreed, CASE WHEN yes = 3 THEN true WHEN no = 3 THEN false ELSE fourth END AS label, fourth IS NOT NULL AS judged FROM b LEFT JOIN a USING (user_id, bin))"""


@BOOK.add(
    f"""{_VOTES} SELECT user_id, count(*) AS bins, CAST(sum(unsure) AS BIGINT) AS unsure, round(sum(unsure) / (3 * count(*)), 6) AS unsure_share, count_if(unsure > 0) AS bins_unsure, count_if(NOT agreed) AS disputed,
count_if(NOT agreed AND judged) AS adjudicated, count_if(label IS NULL) AS unresolved, count_if(coalesce(label, false)) AS positives FROM r GROUP BY user_id"""
)
def rater_resolution(spark, d):
    """Three votes of a bin: a unanimous one holds, else the fourth judgment; what has none stays unresolved."""
    e = events(spark, d).withColumn("bin", F.expr(f"t div {20 * DAY}"))
    said = F.when(F.col("value").between(20, 30), "unsure").when(F.col("value") > 30, "yes").otherwise("no")
    v = e.where("kind <> 'error'").groupBy("user_id", "bin", (F.col("vote") % 3).alias("rater")).agg(F.max(F.struct("t", "event_id", said.alias("v")))["v"].alias("v"))
    fourth = e.where("kind = 'error'").groupBy("user_id", "bin").agg(F.min(F.struct("t", "event_id", (F.col("value") > 30).alias("f")))["f"].alias("fourth"))
    count = lambda what: F.count_if(F.col("v") == what).alias(what)
    b = v.groupBy("user_id", "bin").agg(count("yes"), count("no"), count("unsure"), F.count(F.lit(1)).alias("n")).where("n = 3").join(fourth, ["user_id", "bin"], "left")
    agreed = (F.col("yes") == 3) | (F.col("no") == 3)
    b = b.withColumn("agreed", agreed).withColumn("label", F.when(F.col("yes") == 3, True).when(F.col("no") == 3, False).otherwise(F.col("fourth")))
    return b.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("bins"), F.sum("unsure").alias("unsure"), r6(F.sum("unsure") / (3 * F.count(F.lit(1)))).alias("unsure_share"), F.count_if(F.col("unsure") > 0).alias("bins_unsure"), F.count_if(~F.col("agreed")).alias("disputed"),
        F.count_if(~F.col("agreed") & F.col("fourth").isNotNull()).alias("adjudicated"), F.count_if(F.col("label").isNull()).alias("unresolved"), F.count_if(F.coalesce("label", F.lit(False))).alias("positives"),
    )


_TOP = f"""WITH {_SC}, x AS (SELECT user_id, event_id, score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM sc),
l AS (SELECT user_id, score, percent, CASE WHEN k <= ceil(n * percent / 100) THEN 1 ELSE 0 END AS y FROM x, (SELECT unnest([15, 50]) AS percent)),
g AS (SELECT user_id, percent, score, sum(y) AS pos, count(*) AS n FROM l GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY user_id, percent) AS positives FROM g WINDOW w AS (PARTITION BY user_id, percent ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@BOOK.add(f"{_TOP}, a AS (SELECT user_id, percent, sum(tp / seen * pos) / max(positives) AS ap FROM c GROUP BY ALL) SELECT percent, round(avg(ap), 6) AS map, count(*) AS users FROM a GROUP BY percent")
def map_at_fractions(spark, d):
    """Mean over users of the average precision of scores against the top shares by value."""
    w = Window.partitionBy("user_id")
    x = _scored(spark, d).select("user_id", "score", F.row_number().over(w.orderBy(F.desc("value"), "event_id")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    lab = x.withColumn("percent", F.explode(F.array(F.lit(15), F.lit(50)))).withColumn("y", (F.col("k") <= F.ceil(F.col("n") * F.col("percent") / 100)).cast("int"))
    ap = me.average_precision(me.curve(lab, ["user_id", "percent"], "score", "y"), ["user_id", "percent"])
    return ap.groupBy("percent").agg(r6(F.avg("ap")).alias("map"), F.count(F.lit(1)).alias("users"))


@BOOK.add(
    f"""WITH {EV} SELECT p.user_id, s.id, count(*) AS inside, count_if(p.score < 0.3) AS dropped, round(coalesce(sum(p.score) FILTER (p.score < 0.3), 0), 6) AS mass_lost, round(sum(p.score), 6) AS mass FROM points p JOIN pred s ON p.user_id = s.user_id AND p.t >= s.s AND p.t < s.e GROUP BY ALL"""
)
def event_risk(spark, d):
    """What dropping low scores takes from each event: rows and score mass within it."""
    inside = iv.points_in(points(spark, d), spans(spark, d, "purchase").select("user_id", "id", "s", "e"), ["user_id"], STRETCH)
    low = F.col("score") < 0.3
    return inside.groupBy("user_id", "id").agg(F.count(F.lit(1)).alias("inside"), F.count_if(low).alias("dropped"), r6(F.coalesce(F.sum(F.when(low, F.col("score"))), F.lit(0.0))).alias("mass_lost"), r6(F.sum("score")).alias("mass"))


_MASKS = f"""WITH {_SC}, l AS (SELECT user_id, event_id, y, unnest(['value', 'score', 'recency']) AS feature, unnest([value, score, CAST(t AS DOUBLE)]) AS v, score FROM sc),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, feature ORDER BY v, event_id) AS k, count(*) OVER (PARTITION BY user_id, feature) AS n FROM l),
m AS (SELECT user_id, feature, budget, count_if(k * 100 <= n * budget AND y = 0) AS fp_gone, count_if(k * 100 <= n * budget AND y = 1) AS tp_gone, coalesce(sum(score) FILTER (k * 100 <= n * budget AND y = 1), 0) AS mass, count_if(y = 1) AS tp, count_if(y = 0) AS fp FROM o, (SELECT unnest([10, 20, 30]) AS budget) GROUP BY ALL)"""


@BOOK.add(
    f"""{_MASKS} SELECT feature, budget, round(avg(fp_gone / nullif(fp, 0)), 6) AS macro_fp, round(avg(tp_gone / nullif(tp, 0)), 6) AS macro_tp, round(sum(fp_gone) / sum(fp), 6) AS pooled_fp, round(sum(tp_gone) / sum(tp), 6) AS pooled_tp, round(sum(mass), 6) AS mass,
round(2 * (sum(tp) - sum(tp_gone)) / (2 * (sum(tp) - sum(tp_gone)) + sum(fp) - sum(fp_gone) + sum(tp_gone)) - 2 * sum(tp) / (2 * sum(tp) + sum(fp)), 6) AS f_change FROM m GROUP BY ALL"""
)
def mask_sweep(spark, d):
    """Each feature's lowest shares dropped per user: false positives and true positives gone, score mass lost, change of F."""
    w = Window.partitionBy("user_id", "feature")
    s = _scored(spark, d)
    pair = lambda name, c: F.struct(F.lit(name).alias("feature"), c.cast("double").alias("v"))
    long = s.select("user_id", "event_id", "y", "score", F.explode(F.array(pair("value", F.col("value")), pair("score", F.col("score")), pair("recency", F.col("t")))).alias("x")).select("*", "x.*")
    o = long.select("user_id", "feature", "y", "score", F.row_number().over(w.orderBy("v", "event_id")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    o = o.withColumn("budget", F.explode(F.array(F.lit(10), F.lit(20), F.lit(30))))
    gone, yes = F.col("k") * 100 <= F.col("n") * F.col("budget"), F.col("y") == 1
    m = o.groupBy("user_id", "feature", "budget").agg(F.count_if(gone & ~yes).alias("fp_gone"), F.count_if(gone & yes).alias("tp_gone"), F.coalesce(F.sum(F.when(gone & yes, F.col("score"))), F.lit(0.0)).alias("mass"), F.count_if(yes).alias("tp"), F.count_if(~yes).alias("fp"))
    total = lambda c: F.sum(c)
    tp, fp, a, b = total("tp"), total("fp"), total("tp_gone"), total("fp_gone")
    return m.groupBy("feature", "budget").agg(
        r6(F.avg(ratio(F.col("fp_gone"), F.col("fp")))).alias("macro_fp"), r6(F.avg(ratio(F.col("tp_gone"), F.col("tp")))).alias("macro_tp"), r6(b / fp).alias("pooled_fp"), r6(a / tp).alias("pooled_tp"), r6(total("mass")).alias("mass"),
        r6(2 * (tp - a) / (2 * (tp - a) + fp - b + a) - 2 * tp / (2 * tp + fp)).alias("f_change"),
    )


@BOOK.add(
    f"""WITH {EV}, l AS (SELECT unnest(['kind', 'vote', 'weekday']) AS stratifier, unnest([kind, CAST(vote AS VARCHAR), CAST(t // {DAY} % 7 AS VARCHAR)]) AS level, value, score FROM ev)
SELECT stratifier, level, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(avg(score), 6) AS score FROM l GROUP BY ALL"""
)
def strata_audit(spark, d):
    pair = lambda name, c: F.struct(F.lit(name).alias("stratifier"), c.cast("string").alias("level"))
    e = events(spark, d)
    long = e.select("value", "score", F.explode(F.array(pair("kind", F.col("kind")), pair("vote", F.col("vote")), pair("weekday", F.expr(f"t div {DAY} % 7")))).alias("x")).select("value", "score", "x.*")
    by = ["stratifier", "level"]
    out = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), r6(F.avg("score")).alias("score"))
    return out.join(me.quantiles(long, by, "value", {"median": 0.5}), by, "left").withColumn("median", r6("median"))


@BOOK.add(
    f"""WITH {EV}, u AS (SELECT vote, user_id, avg(value) FILTER (kind = 'view') - avg(value) FILTER (kind = 'purchase') AS delta FROM ev GROUP BY ALL), k AS (SELECT vote, delta FROM u WHERE delta IS NOT NULL)
SELECT vote, count(*) AS sources, round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.5), 6) AS median, round(greatest(count_if(delta > 0), count_if(delta < 0)) / count(*), 6) AS same_sign, round(quantile_cont(delta, 0.05), 6) AS low_tail, round(quantile_cont(delta, 0.95), 6) AS high_tail FROM k GROUP BY vote"""
)
def source_summary(spark, d):
    """Sources count alike whatever their rows: mean, median, tails and share of the commoner sign of their deltas."""
    side = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("value")))
    k = events(spark, d).groupBy("vote", "user_id").agg((side("view") - side("purchase")).alias("delta")).where("delta is not null")
    out = k.groupBy("vote").agg(F.count(F.lit(1)).alias("sources"), r6(F.avg("delta")).alias("mean"), r6(F.greatest(F.count_if(F.col("delta") > 0), F.count_if(F.col("delta") < 0)) / F.count(F.lit(1))).alias("same_sign"))
    q = me.quantiles(k, ["vote"], "delta", {"median": 0.5, "low_tail": 0.05, "high_tail": 0.95})
    return out.join(q, "vote", "left").select("vote", "sources", "mean", "same_sign", *[r6(c).alias(c) for c in ("median", "low_tail", "high_tail")])


_WEIGHT = """CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 ELSE 5 END"""


def _draw(draws: int):
    """Draw numbers and Poisson weights of a user, from a hash."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.col("user_id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296
    w = F.when(u < 0.36787944117144233, 0).when(u < 0.7357588823428847, 1).when(u < 0.9196986029286058, 2).when(u < 0.9810118431238462, 3).when(u < 0.9963401531726563, 4).otherwise(5)
    return lambda df: df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", w).where("w > 0")


def _draws_sql(src: str, draws: int) -> str:
    return f"(SELECT *, {_WEIGHT} AS w FROM (SELECT *, CAST(concat('0x', substr(md5(concat_ws('|', CAST(draw AS VARCHAR), CAST(user_id AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296 AS u FROM {src}, (SELECT unnest(range(1, {draws + 1})) AS draw)))"


@BOOK.add(
    f"""WITH {EV}, s AS (SELECT user_id, sum(score) AS num, count_if(kind <> 'error') AS den FROM ev GROUP BY user_id), r AS (SELECT draw, sum(w * num) / nullif(sum(w * den), 0) AS x FROM {_draws_sql('s', 200)} GROUP BY draw)
SELECT round((SELECT sum(num) / sum(den) FROM s), 6) AS ratio, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM r"""
)
def ratio_bootstrap(spark, d):
    """Interval of a ratio of sums with users as clusters: Poisson weights drawn by hash, 200 times."""
    s = events(spark, d).groupBy("user_id").agg(F.sum("score").alias("num"), F.count_if(F.col("kind") != "error").alias("den"))
    r = _draw(200)(s).groupBy("draw").agg((F.sum(F.col("w") * F.col("num")) / F.sum(F.col("w") * F.col("den"))).alias("x"))
    whole = s.agg(r6(F.sum("num") / F.sum("den")).alias("ratio"))
    return whole.crossJoin(r.agg(r6(F.percentile("x", 0.025)).alias("low"), r6(F.percentile("x", 0.975)).alias("high")))  # one row each


@BOOK.add(
    f"""WITH {_SC}, s AS (SELECT user_id, score, sum(y) AS pos, count(*) AS n FROM sc GROUP BY ALL), g AS (SELECT draw, score, sum(w * pos) AS pos, sum(w * (n - pos)) AS neg FROM {_draws_sql('s', 40)} GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER (PARTITION BY draw ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp FROM g), a AS (SELECT draw, sum(neg * (tp - pos / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM c GROUP BY draw)
SELECT round(avg(auc), 6) AS mean, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high FROM a"""
)
def auc_bootstrap(spark, d):
    """Interval of the pooled AUROC with users as clusters; rows are summed by score before the draws."""
    s = _scored(spark, d).groupBy("user_id", "score").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    g = _draw(40)(s).groupBy("draw", "score").agg(F.sum(F.col("w") * F.col("pos")).alias("pos"), F.sum(F.col("w") * (F.col("n") - F.col("pos"))).alias("neg"))
    c = me.prefix_sums(me.bucketed(g, "score"), ["draw"], "score", ["pos"], F.col("_at")).withColumnRenamed("c_pos", "tp")
    a = c.groupBy("draw").agg(F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))
    return a.agg(r6(F.avg("auc")).alias("mean"), r6(F.percentile("auc", 0.025)).alias("low"), r6(F.percentile("auc", 0.975)).alias("high"))


@BOOK.add(
    f"""WITH {_SC}, r AS (SELECT user_id, trial, y, row_number() OVER (PARTITION BY user_id, trial ORDER BY md5(concat_ws('|', CAST(trial AS VARCHAR), CAST(event_id AS VARCHAR))), event_id) AS k, count(*) OVER (PARTITION BY user_id, trial) AS n FROM sc, (SELECT unnest(range(1, 11)) AS trial)),
t AS (SELECT user_id, trial, sum(y) FILTER (k <= ceil(n * 0.3)) / nullif(sum(y), 0) AS kept FROM r GROUP BY ALL) SELECT user_id, round(avg(kept), 6) AS expected, round(stddev_pop(kept), 6) AS sd FROM t GROUP BY user_id HAVING avg(kept) IS NOT NULL"""
)
def random_retention(spark, d):
    """Positives that a random choice of 30 % of a user's rows keeps: ten draws in hash order."""
    w = Window.partitionBy("user_id", "trial")
    x = _scored(spark, d).select("user_id", "event_id", "y", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("trial"))
    key = F.md5(F.concat_ws("|", F.col("trial").cast("string"), F.col("event_id").cast("string")))
    x = x.select("user_id", "trial", "y", F.row_number().over(w.orderBy(key, "event_id")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    t = x.groupBy("user_id", "trial").agg(ratio(F.sum(F.when(F.col("k") <= F.ceil(F.col("n") * 0.3), F.col("y"))), F.sum("y")).alias("kept"))
    return t.groupBy("user_id").agg(r6(F.avg("kept")).alias("expected"), r6(F.stddev_pop("kept")).alias("sd")).where("expected is not null")


@BOOK.add(f"WITH {_SC}, u AS (SELECT user_id, count_if(score >= 0.4) AS kept, sum(y) AS tp, count(*) AS n FROM sc GROUP BY user_id) SELECT CAST(sum(least(kept, tp)) AS BIGINT) AS bound, CAST(sum(tp) AS BIGINT) AS positives, count_if(tp > 0 AND kept / n < 0.5) AS below_half, count_if(tp > 0 AND kept = 0) AS nothing_kept FROM u")
def budget_bound(spark, d):
    """The most true positives that the kept counts allow, and users whose recall guard fails."""
    u = _scored(spark, d).groupBy("user_id").agg(F.count_if(F.col("score") >= 0.4).alias("kept"), F.sum("y").alias("tp"), F.count(F.lit(1)).alias("n"))
    return u.agg(F.sum(F.least("kept", "tp")).alias("bound"), F.sum("tp").alias("positives"), F.count_if((F.col("tp") > 0) & (F.col("kept") / F.col("n") < 0.5)).alias("below_half"), F.count_if((F.col("tp") > 0) & (F.col("kept") == 0)).alias("nothing_kept"))


@BOOK.add(
    f"""WITH {EV}, o AS (SELECT user_id, t, event_id, value, value - lag(value) OVER w AS d FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), a AS (SELECT *, d - lag(d) OVER (PARTITION BY user_id ORDER BY t, event_id) AS a FROM o),
l AS (SELECT unnest(['displacement', 'acceleration']) AS measure, unnest([abs(d), abs(a)]) AS v FROM a) SELECT measure, count(v) AS n, round(avg(v), 6) AS mean, round(avg(CASE WHEN v > 20 + 1e-9 THEN 1.0 ELSE 0 END) FILTER (v IS NOT NULL), 6) AS over_20, round(avg(CASE WHEN v > 50 + 1e-9 THEN 1.0 ELSE 0 END) FILTER (v IS NOT NULL), 6) AS over_50 FROM l GROUP BY measure"""
)
def jump_ratios(spark, d):
    """Displacements and accelerations of all users in one pool, and the shares above thresholds."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    o = events(spark, d).select("user_id", "t", "event_id", (F.col("value") - F.lag("value").over(w)).alias("d"))
    o = o.select(F.abs("d").alias("displacement"), F.abs(F.col("d") - F.lag("d").over(w)).alias("acceleration"))
    long = o.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in o.columns])).alias("x")).select("x.*").where("v is not null")
    share = lambda x: r6(F.avg((F.col("v") > x + 1e-9).cast("double")))
    return long.groupBy("measure").agg(F.count("v").alias("n"), r6(F.avg("v")).alias("mean"), share(20).alias("over_20"), share(50).alias("over_50"))


_GUARD = f"""WITH {EV}, g AS (SELECT user_id, t, event_id, kind, value > 30 AS guarded, greatest(value - 30, 0) AS correction, value FROM ev), m AS (SELECT *, coalesce(lag(guarded) OVER w, false) AS before, value - lag(value) OVER w AS step FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
i AS (SELECT *, sum(CASE WHEN guarded AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)"""


def _guarded(spark, d):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    g = events(spark, d).select("user_id", "t", "event_id", "kind", "value", (F.col("value") > 30).alias("guarded"), F.greatest(F.col("value") - 30, F.lit(0.0)).alias("correction"))
    g = g.withColumn("before", F.lag("guarded", 1, False).over(w)).withColumn("step", F.col("value") - F.lag("value").over(w))
    return g.withColumn("run", F.sum((F.col("guarded") & ~F.col("before")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


@BOOK.add(
    f"""{_GUARD}, n AS (SELECT user_id, run, count(*) AS n FROM i WHERE guarded GROUP BY ALL), x AS (SELECT user_id, count(*) AS runs, max(n) AS longest FROM n GROUP BY user_id), s AS (SELECT user_id, count(*) AS rows, count_if(guarded) AS hit, sum(correction) AS sum_c, max(correction) AS max_c FROM i GROUP BY user_id)
SELECT user_id, rows, round(hit / rows, 6) AS rate, coalesce(runs, 0) AS runs, coalesce(longest, 0) AS longest, round(sum_c / nullif(hit, 0), 6) AS mean_correction, round(max_c, 6) AS max_correction FROM s LEFT JOIN x USING (user_id)"""
)
def guard_diagnostics(spark, d):
    """How often a guard moves a value, in what runs and how far."""
    g = _guarded(spark, d)
    runs = g.where("guarded").groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("longest"))
    s = g.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("guarded").alias("hit"), F.sum("correction").alias("sum_c"), F.max("correction").alias("max_c"))
    return s.join(runs, "user_id", "left").select("user_id", "rows", r6(F.col("hit") / F.col("rows")).alias("rate"), F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("longest", F.lit(0)).alias("longest"), r6(ratio(F.col("sum_c"), F.col("hit"))).alias("mean_correction"), r6("max_c").alias("max_correction"))


@BOOK.add(f"{_GUARD} SELECT CASE WHEN before THEN 'guarded' ELSE 'free' END AS state_before, CASE WHEN guarded THEN 'guarded' ELSE 'free' END AS state, coalesce(kind, 'all') AS kind, count(*) AS n, CAST(sum(CAST(abs(step) AS DECIMAL(12,2))) AS DOUBLE) AS steps FROM i WHERE step IS NOT NULL GROUP BY GROUPING SETS ((before, guarded, kind), (before, guarded))")
def state_transitions(spark, d):
    """Steps and their length by the state before and after, overall and by kind; a sum of decimals, which no order changes."""
    name = lambda c: F.when(F.col(c), "guarded").otherwise("free").alias
    g = _guarded(spark, d).where("step is not null").select(name("before")("state_before"), name("guarded")("state"), "kind", F.abs("step").alias("step"))
    out = g.groupingSets([["state_before", "state", "kind"], ["state_before", "state"]], "state_before", "state", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("step").cast("decimal(12,2)")).cast("double").alias("steps"))
    return out.withColumn("kind", F.coalesce("kind", F.lit("all")))


@BOOK.add(f"WITH {_RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n, run) AS place, count(*) OVER (PARTITION BY user_id) AS runs FROM rn) SELECT user_id, CAST(run AS BIGINT) AS run, n FROM o WHERE place <= greatest(1, ceil(runs / 4))")
def shortest_runs(spark, d):
    """The shortest quarter of each user's runs, one at least."""
    w = Window.partitionBy("user_id")
    o = _runs(spark, d).select("user_id", "run", "n", F.row_number().over(w.orderBy("n", "run")).alias("place"), F.count(F.lit(1)).over(w).alias("runs"))
    return o.where(F.col("place") <= F.greatest(F.ceil(F.col("runs") / 4), F.lit(1))).select("user_id", "run", "n")


_SHOTS = f"""WITH {EV}, b AS (SELECT DISTINCT user_id, t AS s FROM ev WHERE kind = 'signup'), sh AS (SELECT user_id, s, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS e FROM b),
p AS (SELECT user_id, t, score, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS until FROM ev WHERE kind = 'click')"""


@BOOK.add(
    f"""{_SHOTS} SELECT sh.user_id, sh.s, sh.e, count(*) AS samples, round(sum((least(until, e) - t) / 1e6 * score) / nullif(sum((least(until, e) - t) / 1e6), 0), 6) AS score FROM sh JOIN p ON p.user_id = sh.user_id AND p.t >= sh.s AND p.t < sh.e WHERE sh.e IS NOT NULL AND until IS NOT NULL GROUP BY ALL"""
)
def shot_scores(spark, d):
    """Boundaries to half-open shots; a shot's score weighs each sample by the time it covers in the shot."""
    e = events(spark, d)
    b = e.where("kind = 'signup'").select("user_id", F.col("t").alias("s")).distinct()
    shots = b.select("user_id", "s", F.lead("s").over(Window.partitionBy("user_id").orderBy("s")).alias("e")).where("e is not null")
    p = e.where("kind = 'click'").select("user_id", "t", "score", F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")).alias("until")).where("until is not null")
    inside = iv.points_in(p, shots, ["user_id"], STRETCH)
    weight = (F.least("until", "e") - F.col("t")) / 1e6
    return inside.groupBy("user_id", "s", "e").agg(F.count(F.lit(1)).alias("samples"), r6(ratio(F.sum(weight * F.col("score")), F.sum(weight))).alias("score"))


@BOOK.add(
    """WITH x AS (SELECT o_orderkey, concat('{"customer":', o_custkey, ',"key":', o_orderkey, ',"priority":"', o_orderpriority, '","status":"', o_orderstatus, '"}') AS body FROM orders) SELECT o_orderkey, sha256(body) AS id, concat('raw-', substr(sha256(body), 1, 16)) AS short FROM x"""
)
def content_ids(spark, d):
    """Ids that follow from content: SHA-256 of canonical JSON, whose keys are in order and whose numbers have one form."""
    o = table(spark, d, "orders").select("o_orderkey", canonical_json(key=F.col("o_orderkey"), customer=F.col("o_custkey"), status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")).alias("body"))
    return o.select("o_orderkey", F.sha2("body", 256).alias("id"), F.concat(F.lit("raw-"), F.substring(F.sha2("body", 256), 1, 16)).alias("short"))
