"""Ranking, agreement, summary and loss metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import ln, log_loss, log_loss_of_logit, ratio, softplus, wilson
from ..operators import metrics as me
from .book import Book
from .tables import EV, events, r6, table

BOOK = Book()
BY = ["user_id"]
#: Scores with ties; the label is whether the event is a purchase.
_SC = f"{EV}, sc AS (SELECT user_id, event_id, round(score, 2) AS score, CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END AS y, value, kind, t FROM ev)"


def _scored(spark, d):
    return events(spark, d).select("user_id", "event_id", F.round("score", 2).alias("score"), F.when(F.col("kind") == "purchase", 1).otherwise(0).alias("y"), "value", "kind", "t")


def _curve_sql(part: str) -> str:
    p = f"PARTITION BY {part} " if part else ""
    cols = f"{part}, " if part else ""
    return f"""WITH {_SC}, g AS (SELECT {cols}score, sum(y) AS pos, count(*) AS n FROM sc GROUP BY {cols}score),
c AS (SELECT {cols}score, pos, n, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER ({p}) AS positives, sum(n) OVER ({p}) AS rows FROM g WINDOW w AS ({p}ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


_RATES = "r AS (SELECT *, tp / (tp + fp) AS p, tp / nullif(positives, 0) AS r, 1 - (tp + fp) / rows AS pruned FROM c), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM r)"


@BOOK.add(f"{_curve_sql('user_id')} SELECT user_id, round(CASE WHEN max(positives) > 0 THEN sum(tp / (tp + fp) * pos / positives) END, 6) AS ap FROM c GROUP BY user_id")
def ap_tied(spark, d):
    return me.average_precision(me.curve(_scored(spark, d), BY, "score", "y"), BY).select("user_id", r6("ap").alias("ap"))


@BOOK.add(f"{_curve_sql('')} SELECT round(sum(tp / (tp + fp) * pos / positives), 6) AS ap, round(sum((n - pos) * (tp - pos + pos / 2)) / (max(positives) * max(rows - positives)), 6) AS auroc FROM c")
def ap_auroc_pooled(spark, d):
    c = me.curve(_scored(spark, d), [], "score", "y")
    both = me.average_precision(c, []).crossJoin(F.broadcast(me.auroc(c, [])))  # one row each
    return both.select(r6("ap").alias("ap"), r6("auroc").alias("auroc"))


@BOOK.add(f"{_curve_sql('')}, {_RATES} SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(p, 6) AS precision, round(r, 6) AS recall FROM f")
def pr_curve(spark, d):
    return me.with_rates(me.curve(_scored(spark, d), [], "score", "y")).select("score", "tp", "fp", r6("precision").alias("precision"), r6("recall").alias("recall"))


@BOOK.add(f"{_curve_sql('user_id')} SELECT user_id, round(sum((n - pos) * (tp - pos + pos / 2)) / nullif(max(positives) * max(rows - positives), 0), 6) AS auroc FROM c GROUP BY user_id")
def auroc(spark, d):
    return me.auroc(me.curve(_scored(spark, d), BY, "score", "y"), BY).select("user_id", r6("auroc").alias("auroc"))


_BEST = "SELECT user_id, score AS tau, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(pruned, 6) AS pruned FROM k WHERE k = 1"


@BOOK.add(f"{_curve_sql('user_id')}, {_RATES}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(f1, 12) DESC, r DESC, score) AS k FROM f) {_BEST}")
def tau_f1(spark, d):
    return me.best_threshold(me.curve(_scored(spark, d), BY, "score", "y"), BY, "score").select("user_id", "tau", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "pruned")])


@BOOK.add(f"{_curve_sql('user_id')}, {_RATES}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(pruned, 12) DESC, r DESC, score DESC) AS k FROM f WHERE r >= 0.95) {_BEST}")
def tau_safe(spark, d):
    return me.best_threshold(me.curve(_scored(spark, d), BY, "score", "y"), BY, "score", recall=0.95).select("user_id", "tau", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "pruned")])


@BOOK.add(
    f"""WITH {_SC}, x AS (SELECT user_id, y, sum(y) OVER w AS tp, row_number() OVER w AS k FROM sc WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, round(CASE WHEN sum(y) > 0 THEN sum(y * tp / k) / sum(y) END, 6) AS ap FROM x GROUP BY user_id"""
)
def ap_untied(spark, d):
    return me.average_precision_in_order(_scored(spark, d), BY, "score", "event_id", "y").select("user_id", r6("ap").alias("ap"))


@BOOK.add(
    f"""WITH {_SC}, t AS (SELECT user_id, count_if(y = 1 AND score >= 0.5) AS tp, count_if(y = 0 AND score >= 0.5) AS fp, count_if(y = 1 AND score < 0.5) AS fn, count_if(y = 0 AND score < 0.5) AS tn FROM sc GROUP BY user_id),
m AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM t) SELECT user_id, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM m"""
)
def confusion(spark, d):
    out = me.confusion(_scored(spark, d), BY, F.col("y") == 1, F.col("score") >= 0.5)
    return out.select("user_id", "tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@BOOK.add(
    f"""WITH {_SC}, g AS (SELECT unnest(range(0, 101)) AS k), t AS (SELECT k / 100 AS tau, count_if(y = 1) AS tp, count(*) AS n FROM g JOIN sc ON CAST(round(score * 100) AS BIGINT) >= k GROUP BY k)
SELECT tau, n, CAST(tp AS BIGINT) AS tp, round(tp / n, 6) AS precision FROM t"""
)
def threshold_sweep(spark, d):
    """A grid of 101 thresholds: rows are counted by grid cell first, so the grid meets 101 rows, not the table."""
    cells = _scored(spark, d).groupBy(F.round(F.col("score") * 100).cast("bigint").alias("cell")).agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("c"))
    below = cells.select(F.explode(F.sequence(F.lit(0).cast("bigint"), "cell")).alias("k"), "y", "c")
    return below.groupBy("k").agg(F.sum("c").alias("n"), F.sum("y").alias("tp")).select((F.col("k") / 100).alias("tau"), "n", "tp", r6(F.col("tp") / F.col("n")).alias("precision"))


@BOOK.add(
    f"""WITH {_SC}, k AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY score) + (count(*) OVER (PARTITION BY user_id, score) - 1) / 2 AS rx, rank() OVER (PARTITION BY user_id ORDER BY event_id % 11) + (count(*) OVER (PARTITION BY user_id, event_id % 11) - 1) / 2 AS ry FROM sc)
SELECT user_id, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM k GROUP BY user_id"""
)
def spearman(spark, d):
    return me.spearman(_scored(spark, d).withColumn("z", F.col("event_id") % 11), BY, "score", "z").select("user_id", r6("rho").alias("rho"), "n")


@BOOK.add(
    f"""WITH {_SC}, p AS (SELECT a.user_id, sign(a.score - b.score) AS x, sign(a.event_id % 11 - b.event_id % 11) AS z FROM sc a JOIN sc b ON a.user_id = b.user_id AND a.event_id < b.event_id)
SELECT user_id, round(sum(x * z) / sqrt(nullif(sum(abs(x)) * sum(abs(z)), 0)), 6) AS tau FROM p GROUP BY user_id"""
)
def kendall_tau_b(spark, d):
    return me.kendall_tau_b(_scored(spark, d).withColumn("z", F.col("event_id") % 11).select("user_id", "event_id", "score", "z"), BY, "score", "z", "event_id").select("user_id", r6("tau").alias("tau"))


@BOOK.add(
    f"""WITH {_SC}, x AS (SELECT user_id, event_id % 6 AS g, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 6 DESC, event_id) AS b, ceil(count(*) OVER (PARTITION BY user_id) * 0.15 - 1e-12) AS k FROM sc)
SELECT user_id, round(sum(CASE WHEN a <= k THEN g / log2(a + 1) END) / nullif(sum(CASE WHEN b <= k THEN g / log2(b + 1) END), 0), 6) AS ndcg FROM x GROUP BY user_id"""
)
def ndcg15(spark, d):
    return me.ndcg(_scored(spark, d).withColumn("g", F.col("event_id") % 6), BY, "score", "g", "event_id", 0.15).select("user_id", r6("ndcg").alias("ndcg"))


@BOOK.add(
    """WITH v AS (SELECT d.lang, coalesce(l.quality, 0) + coalesce(l.toxic, 0) + CAST(d.n_chars % 2 AS INT) AS y FROM documents d JOIN labels l USING (doc_id) WHERE d.lang IS NOT NULL),
t AS (SELECT lang, count(*) AS items, avg(CASE WHEN y IN (0, 3) THEN 1.0 ELSE 0.0 END) AS unanimous, avg((y * (y - 1) + (3 - y) * (2 - y)) / 6) AS pairwise, sum(y) / (count(*) * 3) AS p FROM v GROUP BY lang)
SELECT lang, items, round(unanimous, 6) AS unanimous, round(pairwise, 6) AS pairwise, round((pairwise - (p * p + (1 - p) * (1 - p))) / nullif(1 - (p * p + (1 - p) * (1 - p)), 0), 6) AS kappa FROM t"""
)
def fleiss_kappa(spark, d):
    docs = table(spark, d, "documents").where("lang is not null").select("doc_id", "lang", "n_chars")
    v = docs.join(table(spark, d, "labels"), "doc_id").select("lang", (F.coalesce("quality", F.lit(0)) + F.coalesce("toxic", F.lit(0)) + (F.col("n_chars") % 2).cast("int")).alias("y"))
    out = me.fleiss(v, ["lang"], "y", 3)
    return out.select("lang", "items", *[r6(c).alias(c) for c in ("unanimous", "pairwise", "kappa")])


@BOOK.add(
    f"""WITH {EV}, o AS (SELECT kind, list_sort(list(value)) AS v FROM ev GROUP BY kind), q AS (SELECT unnest([0.1, 0.5, 0.9]) AS q)
SELECT kind, list_extract(v, CAST(least(floor(q * len(v)), len(v) - 1) + 1 AS BIGINT)) AS value, q FROM o, q"""
)
def index_percentiles(spark, d):
    out = me.quantiles(events(spark, d), ["kind"], "value", {f"q{i}": q for i, q in enumerate((0.1, 0.5, 0.9))}, between=False)
    return out.select("kind", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"q{i}").alias("value")) for i, q in enumerate((0.1, 0.5, 0.9))])).alias("x")).select("kind", "x.q", "x.value")


@BOOK.add(
    f"""WITH {EV} SELECT kind, count(*) AS n, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM ev WHERE kind IS NOT NULL GROUP BY kind"""
)
def describe(spark, d):
    e = events(spark, d).where("kind is not null")
    plain = e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("sd"))
    p = me.quantiles(e, ["kind"], "value", {"p25": 0.25, "p50": 0.5, "p95": 0.95})
    return plain.join(p.select("kind", *[r6(c).alias(c) for c in ("p25", "p50", "p95")]), "kind", "left")


@BOOK.add("SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity, round(CAST(sum(CAST(l_discount AS DECIMAL(12,2))) AS DOUBLE) / count(l_discount), 6) AS discount FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def strata_grouping_sets(spark, d):
    """Sums of decimals: no order of addition changes them."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(12,2)")).cast("double")
    line = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    out = line.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), exact("l_quantity").alias("quantity"), r6(ratio(exact("l_discount"), F.count("l_discount"))).alias("discount"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "quantity", "discount")


_FIELDS = "(SELECT event_id % 3 = 0 AS y, 'value' AS field, CASE WHEN value > 20 THEN value END AS v FROM ev UNION ALL SELECT event_id % 3 = 0, 'score', CASE WHEN score < 0.8 THEN score END FROM ev UNION ALL SELECT event_id % 3 = 0, 'vote', CASE WHEN NOT (vote = 0 AND event_id % 3 = 0) THEN vote END FROM ev)"


def _fields(spark, d):
    e = events(spark, d)
    vote = F.when(~((F.col("vote") == 0) & (F.col("event_id") % 3 == 0)), F.col("vote"))
    return e.select((F.col("event_id") % 3 == 0).alias("y"), F.when(F.col("value") > 20, F.col("value")).alias("value"), F.when(F.col("score") < 0.8, F.col("score")).alias("score"), vote.cast("double").alias("vote"))


@BOOK.add(f"WITH {EV}, f AS {_FIELDS}, m AS (SELECT field, avg(CASE WHEN v IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (y) - avg(CASE WHEN v IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (NOT y) AS delta FROM f GROUP BY field) SELECT field, round(delta, 6) AS delta, abs(delta) > 0.1 AS flagged FROM m")
def missingness_audit(spark, d):
    f = _fields(spark, d)
    long = f.select("y", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).isNotNull().cast("double").alias("seen")) for c in ("value", "score", "vote")])).alias("x")).select("y", "x.*")
    delta = F.avg(F.when(F.col("y"), F.col("seen"))) - F.avg(F.when(~F.col("y"), F.col("seen")))
    return long.groupBy("field").agg(delta.alias("delta")).select("field", r6("delta").alias("delta"), (F.abs("delta") > 0.1).alias("flagged"))


@BOOK.add(
    f"""WITH {EV}, f AS {_FIELDS} SELECT field, count(*) AS rows, count(*) - count(v) AS missing, round(min(v), 6) AS low, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.95), 6) AS p95, count(DISTINCT round(v, 6)) AS "distinct", round(max(v), 6) AS high FROM f GROUP BY field"""
)
def field_stats(spark, d):
    out = me.field_stats(_fields(spark, d), ["value", "score", "vote"])
    return out.select("field", "rows", "missing", "distinct", *[r6(c).alias(c) for c in ("low", "mean", "sd", "median", "p95", "high")])


@BOOK.add(
    f"""WITH {EV}, c AS (SELECT user_id, count_if(kind = 'purchase') AS k, count(*) AS n FROM ev GROUP BY user_id), z AS (SELECT *, 1.959963984540054 AS z, k / n AS p FROM c)
SELECT user_id, round(greatest(((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0), 6) AS low, round(least(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1), 6) AS high FROM z"""
)
def wilson_interval(spark, d):
    c = events(spark, d).groupBy("user_id").agg(F.count_if(F.col("kind") == "purchase").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return c.select("user_id", r6(low).alias("low"), r6(high).alias("high"))


@BOOK.add(
    f"""WITH {EV}, t AS (SELECT vote, avg(value) FILTER (kind = 'view') AS ma, avg(value) FILTER (kind <> 'view') AS mb, var_samp(value) FILTER (kind = 'view') AS va, var_samp(value) FILTER (kind <> 'view') AS vb, count(*) FILTER (kind = 'view') AS na, count(*) FILTER (kind <> 'view') AS nb FROM ev GROUP BY vote)
SELECT vote, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM t"""
)
def cohens_d(spark, d):
    return me.effect_size(events(spark, d), ["vote"], "value", F.col("kind") == "view").select("vote", r6("d").alias("d"))


@BOOK.add(
    f"""WITH {_SC}, x AS (SELECT user_id, y, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM sc), q AS (SELECT unnest([10, 25, 50, 75]) AS percent)
SELECT user_id, percent, round(sum(CASE WHEN k * 100 <= n * percent THEN y ELSE 0 END) / nullif(sum(y), 0), 6) AS kept_positives, round(sum(CASE WHEN k * 100 > n * percent THEN 1 - y ELSE 0 END) / nullif(sum(1 - y), 0), 6) AS dropped_negatives FROM x, q GROUP BY user_id, percent"""
)
def retention_curve(spark, d):
    return me.retention(_scored(spark, d), BY, "score", "event_id", "y", [10, 25, 50, 75]).select("user_id", "percent", r6("kept_positives").alias("kept_positives"), r6("dropped_negatives").alias("dropped_negatives"))


@BOOK.add(f"WITH {_SC}, x AS (SELECT user_id, y, ntile(5) OVER (PARTITION BY user_id ORDER BY score, event_id) AS q FROM sc) SELECT user_id, CAST(q AS INT) AS q, count(*) AS n, round(avg(y), 6) AS density FROM x GROUP BY user_id, q")
def quintile_density(spark, d):
    from pyspark.sql import Window

    x = _scored(spark, d).withColumn("q", F.ntile(5).over(Window.partitionBy("user_id").orderBy("score", "event_id")))
    return x.groupBy("user_id", "q").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("y")).alias("density"))


@BOOK.add(f"WITH {EV} SELECT user_id, t // 7200000000 AS bin, count(*) AS n, round(avg(score), 6) AS mean FROM ev GROUP BY ALL")
def pool_to_bins(spark, d):
    return events(spark, d).groupBy("user_id", F.expr("t div 7200000000").alias("bin")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("mean"))


@BOOK.add(f"WITH {EV} SELECT event_id, round(exp(score - max(score) OVER p) / sum(exp(score - 1)) OVER p * exp(max(score) OVER p - 1), 6) AS share FROM ev WINDOW p AS (PARTITION BY user_id)")
def softmax(spark, d):
    from pyspark.sql import Window

    p = Window.partitionBy("user_id")
    x = events(spark, d).withColumn("x", F.exp(F.col("score") - F.max("score").over(p)))
    return x.select("event_id", r6(F.col("x") / F.sum("x").over(p)).alias("share"))


@BOOK.add(
    f"""WITH {EV}, x AS (SELECT user_id, kind, ln(1 + value) AS v FROM ev), s AS (SELECT avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-8 THEN 1 ELSE stddev_pop(v) END AS sd FROM x WHERE user_id % 10 < 7)
SELECT kind, round(avg(least(greatest((v - m) / sd, -4), 4)), 6) AS mean, round(max(least(greatest((v - m) / sd, -4), 4)), 6) AS high, count_if(abs((v - m) / sd) >= 4) AS clipped FROM x, s GROUP BY kind"""
)
def normalised_features(spark, d):
    """log1p, standardised by statistics of the training users only, clipped at 4."""
    x = events(spark, d).select("user_id", "kind", F.log1p("value").alias("v"))
    s = x.where("user_id % 10 < 7").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd")).select("m", F.when(F.col("sd") < 1e-8, 1.0).otherwise(F.col("sd")).alias("sd"))
    z = x.crossJoin(F.broadcast(s)).withColumn("z", (F.col("v") - F.col("m")) / F.col("sd"))  # one row
    hold = F.least(F.greatest("z", F.lit(-4.0)), F.lit(4.0))
    return z.groupBy("kind").agg(r6(F.avg(hold)).alias("mean"), r6(F.max(hold)).alias("high"), F.count_if(F.abs("z") >= 4).alias("clipped"))


@BOOK.add(
    f"""WITH {EV}, x AS (SELECT user_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT user_id, round(avg(score), 6) AS mean, round(avg(score) FILTER (k <= ceil(n * 0.25)), 6) AS top_quarter, round(0.1 * ln(avg(exp(score / 0.1))), 6) AS soft_max FROM x GROUP BY user_id"""
)
def bag_pooling(spark, d):
    from pyspark.sql import Window

    p = Window.partitionBy("user_id")
    x = events(spark, d).select("user_id", "score", F.row_number().over(p.orderBy(F.desc("score"))).alias("k"), F.count(F.lit(1)).over(p).alias("n"))
    top = F.avg(F.when(F.col("k") <= F.ceil(F.col("n") * 0.25), F.col("score")))
    return x.groupBy("user_id").agg(r6(F.avg("score")).alias("mean"), r6(top).alias("top_quarter"), r6(0.1 * F.ln(F.avg(F.exp(F.col("score") / 0.1)))).alias("soft_max"))


@BOOK.add(
    f"""WITH {_SC}, x AS (SELECT user_id, y, least(greatest(score, 1e-7), 1 - 1e-7) AS p, ln(value) - 3 AS z, vote <> 0 AS m FROM sc JOIN (SELECT event_id, vote FROM ev) USING (event_id))
SELECT user_id, count_if(NOT m) AS masked, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))) FILTER (m), 6) AS bce, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) FILTER (m), 6) AS bce_logits, round(avg(greatest(-z, 0) + ln(1 + exp(-abs(z)))) FILTER (m), 6) AS ranking FROM x GROUP BY user_id"""
)
def losses(spark, d):
    """Means over the rows that the mask (a vote other than 0) lets through; the others are counted."""
    x = events(spark, d).select("user_id", F.round("score", 2).alias("score"), F.when(F.col("kind") == "purchase", 1).otherwise(0).alias("y"), (F.col("vote") != 0).alias("m"), (ln(F.col("value")) - 3).alias("z"))
    y, mean = F.col("y"), lambda c: r6(F.avg(F.when(F.col("m"), c)))
    return x.groupBy("user_id").agg(F.count_if(~F.col("m")).alias("masked"), mean(log_loss(F.col("score"), y)).alias("bce"), mean(log_loss_of_logit(F.col("z"), y)).alias("bce_logits"), mean(softplus(-F.col("z"))).alias("ranking"))


@BOOK.add(
    f"""WITH {EV}, b AS (SELECT kind, sum(vote) AS s, count(*) AS c FROM ev WHERE event_id % 2 = 0 GROUP BY kind), a AS (SELECT kind, sum(vote) AS s, count(*) AS c FROM ev GROUP BY kind)
SELECT a.kind, CAST(a.s - coalesce(b.s, 0) AS BIGINT) AS s, CAST(a.c - coalesce(b.c, 0) AS BIGINT) AS c, round((a.s - coalesce(b.s, 0)) / nullif(a.c - coalesce(b.c, 0), 0), 6) AS mean FROM a LEFT JOIN b USING (kind)"""
)
def metrics_delta(spark, d):
    e = events(spark, d)
    sums = lambda df, s, c: df.groupBy("kind").agg(F.sum("vote").alias(s), F.count(F.lit(1)).alias(c))
    both = sums(e, "s1", "c1").join(sums(e.where("event_id % 2 = 0"), "s0", "c0"), "kind", "left").na.fill(0, ["s0", "c0"])
    s, c = F.col("s1") - F.col("s0"), F.col("c1") - F.col("c0")
    return both.select("kind", s.alias("s"), c.alias("c"), r6(F.when(c != 0, s / c)).alias("mean"))


@BOOK.add(f"WITH {EV}, g AS (SELECT avg(CASE WHEN vote = 0 THEN 1.0 ELSE 0.0 END) AS f FROM ev) SELECT round(f, 6) AS f, CASE WHEN f > 0.95 THEN 'REPLACE' ELSE 'KEEP' END AS decision FROM g")
def variance_gate(spark, d):
    g = events(spark, d).agg(F.avg((F.col("vote") == 0).cast("double")).alias("f"))
    return g.select(r6("f").alias("f"), F.when(F.col("f") > 0.95, "REPLACE").otherwise("KEEP").alias("decision"))
