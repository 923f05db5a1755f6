"""Literal cases and brute-force versions for the operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import boxes as bx
from tidemark.functions.intervals import chunk_count, intersection, iou, union
from tidemark.functions.scalars import canonical_json, parse_rate, wilson
from tidemark.operators import intervals as iv
from tidemark.operators import matching as mt
from tidemark.operators import metrics as me
from tidemark.operators import selection as se
from tidemark.operators import sequences as sq
from tidemark.sources import records as rec
from tidemark.streaming import chunks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def test_interval_arithmetic(spark):
    df = spark.createDataFrame([(0, 10, 5, 15), (0, 1, 5, 6)], "a long, b long, c long, d long")
    x = [F.col(c) for c in "abcd"]
    assert rows(df.select(intersection(*x), union(*x), F.round(iou(*x), 6))) == [(5, 15, 0.333333), (0, 2, 0.0)]
    n = spark.createDataFrame([(d,) for d in (1, 30, 31, 55, 56, 80)], "d long").select("d", chunk_count(F.col("d"), 30, 5))
    assert rows(n, "d") == [(1, 1), (30, 1), (31, 2), (55, 2), (56, 3), (80, 3)]


def test_interval_metrics(spark):
    kind = "k string, s long, e long"
    pred = spark.createDataFrame([("v", 0, 6000), ("v", 4000, 10000), ("z", 2000, 4000)], kind)
    ref = spark.createDataFrame([("v", 5000, 15000), ("z", 0, 0), ("z", 2000, 5000), ("n", 5, 5)], kind)
    got = {r.k: r for r in iv.interval_metrics(pred, ref, ["k"], 3000, least=1).collect()}
    assert (got["v"].both, got["v"].precision, got["v"].recall, got["v"].f1) == (5000, 0.5, 0.5, 0.5)
    assert (got["z"].excluded, got["z"].precision, round(got["z"].recall, 6), round(got["z"].f1, 6)) == (1, 1.0, 0.666667, 0.8)
    assert (got["n"].precision, got["n"].recall, got["n"].tiou) == (1.0, 1.0, 1.0)


def test_union_does_not_depend_on_the_stretch(spark):
    rng = np.random.default_rng(3)
    data = [(int(k), int(s), int(s + n)) for k, s, n in zip(rng.integers(0, 3, 400), rng.integers(-500, 5000, 400), rng.integers(0, 60, 400), strict=True)]
    df = spark.createDataFrame(data, "k long, s long, e long")
    assert rows(iv.coalesce(df, ["k"]), "k", "s") == rows(iv.coalesce(df, ["k"], 100), "k", "s")
    pairs = {(a, b) for a, b in itertools.product(data, data) if a[0] == b[0] and max(a[1], b[1]) < min(a[2], b[2])}
    met = iv.overlaps(df, df, ["k"], 37).distinct()
    assert met.count() == len(pairs)


def test_best_overlap_counts_empty_intervals_inside_of_others(spark):
    kind = "k long, id long, s long, e long"
    a = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 20, 20), (1, 2, 40, 40), (1, 3, 0, 0)], kind)
    b = spark.createDataFrame([(1, 0, 5, 10), (1, 1, 5, 5), (1, 2, 10, 10), (1, 3, 15, 25), (1, 4, 20, 20), (1, 5, 40, 45), (2, 6, 0, 99)], kind)
    for width in (5, 7, 100):
        assert rows(iv.best_overlap(a, b, ["k"], width, "id"), "id") == [(0, 2, 0.5), (1, 1, 0.0)]


def test_threshold_merge(spark):
    kind = "k long, s long, e long, score double, id long"
    df = spark.createDataFrame([(1, 4, 8, 0.7, 0), (1, 5, 9, 0.9, 1), (2, 0, 10, 0.5, 0), (2, 8, 12, 0.6, 1)], kind)
    assert rows(iv.fold_merge(df, ["k"], 0.5), "k", "place") == [(1, 0, 4, 9, 0.9, 2, [0, 1]), (2, 0, 0, 10, 0.5, 1, [0]), (2, 1, 8, 12, 0.6, 1, [1])]


def test_frames_masks_and_votes(spark):
    seg = spark.createDataFrame([(1, 1000, 1500), (2, 0, 2000), (2, 1000, 3000)], "k long, s long, e long")
    f = iv.frames(seg, 30, 1000).groupBy("k").agg(F.min("frame"), F.max("frame"), F.countDistinct("frame"))
    assert rows(f, "k") == [(1, 30, 44, 15), (2, 0, 89, 90)]
    pts = spark.createDataFrame([(i, 1, t) for i, t in enumerate((500, 1000, 1500, 2000, 2500))], "p long, k long, t long")
    one = spark.createDataFrame([(1, 1000, 2000)], "k long, s long, e long")
    assert [r[0] for r in rows(iv.points_in(pts, one, ["k"], 700, "left_semi").select("p"), "p")] == [1, 2]
    users = spark.createDataFrame([(1, 1000, 3000, "u1"), (1, 1500, 3500, "u2"), (1, 1500, 2000, "u1")], "k long, s long, e long, who string")
    at = spark.createDataFrame([(i, 1, i * 1000) for i in (1, 2, 3)], "p long, k long, t long")
    assert [r[3] for r in rows(iv.guard_masks(at, users, ["k"], "p", 10, 1000), "p")] == [1, 2, 1]
    clips = spark.createDataFrame([(1, 2, 6, 5.0), (1, 4, 8, 3.0)], "k long, s long, e long, vote double")
    grid = spark.createDataFrame([(i, 1, i) for i in range(10)], "p long, k long, t long")
    target = {r.p: r.target for r in iv.soft_votes(grid, clips, ["k"], "p", 3).collect()}
    assert [target[i] for i in (2, 4, 5, 6, 8)] == [1.0, 0.8, 0.8, 0.6, 0.0]


def test_ranking_metrics(spark):
    def ap(pairs):
        df = spark.createDataFrame([(1, float(p), y) for y, p in pairs], "k long, score double, y int")
        return me.average_precision(me.curve(df, ["k"], "score", "y"), ["k"]).first().ap

    assert abs(ap([(1, 0.9), (0, 0.8), (1, 0.7)]) - (1 + 2 / 3) / 2) < 1e-12
    assert ap([(1, 0.5), (0, 0.5)]) == 0.5
    assert ap([(0, 0.4), (0, 0.5)]) is None
    ranks = spark.createDataFrame([(1, v) for v in (10, 20, 20, 30)], "k long, v long").select("v", sq.average_rank("v", ["k"]).alias("r"))
    assert sorted(r.r for r in ranks.collect()) == [1, 2.5, 2.5, 4]
    xy = spark.createDataFrame([(k, i, {"a": i, "b": -i, "c": 3}[k]) for k in "abc" for i in range(6)], "k string, x long, y long")
    assert {r.k: r.rho if r.rho is None else round(r.rho, 9) for r in me.spearman(xy, ["k"], "x", "y").collect()} == {"a": 1.0, "b": -1.0, "c": None}
    low, high = wilson(F.lit(5), F.lit(10))
    assert [round(v, 4) for v in spark.range(1).select(low, high).first()] == [0.2366, 0.7634]


def test_prefix_sums_cross_buckets(spark):
    rng = np.random.default_rng(1)
    data = [(int(k), round(float(s), 3), int(y)) for k, s, y in zip(rng.integers(0, 2, 500), rng.random(500), rng.integers(0, 2, 500), strict=True)]
    df = spark.createDataFrame(data, "k long, score double, y int")
    for r in me.curve(df, ["k"], "score", "y", buckets=7).collect():
        kept = [y for k, s, y in data if k == r.k and s >= r.score]
        assert (r.tp, r.tp + r.fp) == (sum(kept), len(kept))


def test_exact_frame_match(spark):
    kind = "v long, frame long, x double, y double, w double, h double"
    box = lambda v, f: (v, f, 0.0, 0.0, 2.0, 2.0)
    pred = spark.createDataFrame([box(1, 1), box(2, 1), box(2, 3)], kind)
    ref = spark.createDataFrame([box(1, 1), box(1, 2), box(2, 1), box(2, 2)], kind)
    got = [(r.precision, r.recall, round(r.f1, 6)) for r in mt.frame_match(pred, ref, ["v"], "frame").orderBy("v").collect()]
    assert got == [(1.0, 0.5, 0.666667), (0.5, 0.5, 0.5)]


def test_smoothing_folds_against_loops(spark):
    rng = np.random.default_rng(5)
    data, t = [], 0
    for i in range(120):
        t += int(rng.choice([1, 1, 1, 5]))
        data.append((1, t, None if i % 17 == 5 else float(rng.integers(0, 100)), 20.0, 60.0))
    df = spark.createDataFrame(data, "k long, t long, v double, lo double, hi double")
    for settings in ({}, {"hold": ("lo", "hi")}, {"hold": ("lo", "hi"), "project": True}, {"adapt": (10.0, 40.0)}):
        state, last, want = None, None, []
        for _, o, v, lo, hi in data:
            fresh = last is None or v is None or o - last > 2 or state is None
            a = 0.5 + 0.5 * min(max((abs(v - state) - 10) / 30, 0), 1) if "adapt" in settings and not fresh else 0.5
            state = v if fresh else state + a * (v - state)
            out = state if "hold" not in settings or state is None else min(max(state, lo), hi)
            state, last = (out if settings.get("project") else state), o
            want.append(out)
        got = [r.smoothed for r in sq.smooth(df, ["k"], "t", "v", 2, **settings).orderBy("t").collect()]
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got, want, strict=True)), settings


def test_boxes(spark):
    df = spark.createDataFrame([(1920, 1080), (1080, 1920), (45, 80)], "w long, h long")
    x, y, w, h = bx.crop_at(F.col("w"), F.col("h"), 9, 16, F.col("w") / 2, F.col("h") / 2)
    assert rows(df.select(x, y, w, h)) == [(656, 0, 607, 1080), (0, 0, 1080, 1920), (0, 0, 45, 80)]
    none = tuple(F.lit(None).cast("double") for _ in range(4))
    assert spark.range(1).select(bx.status(none, F.lit(5), F.lit(5))).first()[0] == "ABSENT"
    assert float(spark.range(1).select(parse_rate(F.lit("30000/1001"))).first()[0]) == round(30000 / 1001, 12)


def test_knapsack_against_all_subsets():
    rng = np.random.default_rng(7)
    for _ in range(60):
        w, v = rng.integers(1, 9, 7), rng.integers(0, 20, 7)
        budget = int(rng.integers(0, 25))
        best = max(sum(v[list(c)]) for n in range(8) for c in itertools.combinations(range(7), n) if sum(w[list(c)]) <= budget)
        chosen = se.knapsack(w, v.astype(float), budget)
        assert sum(w[chosen]) <= budget
        assert sum(v[chosen]) == best


def test_numbering_and_quantiles_in_buckets(spark):
    rng = np.random.default_rng(4)
    data = [(int(k), int(v)) for k, v in zip(rng.integers(0, 3, 500), rng.zipf(1.6, 500) % 1000)] + [(None, 5), (None, 3)]
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(data)], "k long, v long, i long")
    got = se.numbered(df, ["k"], ["v", "i"], F.shiftright("v", 4), "place", "n").collect()
    for key in (0, 1, 2, None):
        mine = sorted((r.v, r.i, r.place, r.n) for r in got if r.k == key)
        assert [x[2] for x in mine] == list(range(1, len(mine) + 1)) and {x[3] for x in mine} == {len(mine)}
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}
    known = df.where("k is not null")
    for row in me.quantiles(known, ["k"], "v", shares, buckets=7).collect():
        values = np.array([v for k, v in data if k == row.k], float)
        assert [round(row[x], 9) for x in shares] == [round(float(np.quantile(values, q)), 9) for q in shares.values()]
    for row in me.quantiles(known, ["k"], "v", shares, between=False).collect():
        values = sorted(v for k, v in data if k == row.k)
        assert [row[x] for x in shares] == [values[min(int(q * len(values)), len(values) - 1)] for q in shares.values()]


def test_best_placements_against_all_offsets(spark):
    rng = np.random.default_rng(7)
    cases = []
    for _ in range(500):
        extent = int(rng.integers(5, 60))
        crop, start = int(rng.integers(1, extent + 1)), float(rng.integers(0, 4 * extent - 3)) / 4
        cases.append((extent, crop, start, min(float(extent), start + float(rng.integers(1, 80)) / 4)))
    df = spark.createDataFrame(cases, "f long, c long, a double, b double")
    out = df.select("*", *[x.alias(n) for x, n in zip(bx.best_placements(*(F.col(x) for x in "fcab")), ("low", "high", "most"))]).collect()
    for r in out:
        over = [max(0.0, min(q + r.c, r.b) - max(q, r.a)) for q in range(r.f - r.c + 1)]
        best = [q for q, x in enumerate(over) if x == max(over)]
        assert (r.low, r.high, r.most) == (best[0], best[-1], max(over)), r


def test_canonical_json(spark):
    df = spark.createDataFrame([(1, -0.0, "a\"b", None), (2, 1.5, "é", True)], "i long, d double, s string, b boolean")
    got = [r[0] for r in df.orderBy("i").select(canonical_json(s=F.col("s"), d=F.col("d"), i=F.col("i"), b=F.col("b"))).collect()]
    assert got == ['{"b":null,"d":0.0,"i":1,"s":"a\\"b"}', '{"b":true,"d":1.5,"i":2,"s":"é"}']
    with pytest.raises(Exception, match="not a JSON number"):
        spark.createDataFrame([(float("nan"),)], "d double").select(canonical_json(d=F.col("d"))).collect()


def test_reader_follows_locators(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"f": 1}\n{"f": 2}\n')
    (tmp_path / "y.jsonl").write_text('{"f": 3}\n')
    records = spark.createDataFrame([("v", "a/x.jsonl"), ("w", "y.jsonl"), ("z", "gone.jsonl")], "id string, at string")
    assert rows(rec.followed(spark, records, "at", str(tmp_path), "f long").select("id", "f"), "id", "f") == [("v", 1), ("v", 2), ("w", 3), ("z", None)]


def test_change_points_against_plain_search():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.05, (5, 3)) for c in (0, 4, -3)])
    assert se.change_points(x, 5) == [5, 10]

    def cost(parts):
        return sum(((x[a:b] - x[a:b].mean(0)) ** 2).sum() for a, b in zip((0, *parts), (*parts, len(x)), strict=True)) / len(x)

    def extra(m):
        return m / (2 * len(x)) * (math.log(len(x) / m) + 1) if m else 0

    best = min((cost(p) + extra(m), p) for m in range(4) for p in itertools.combinations(range(1, len(x)), m))
    assert list(best[1]) == [5, 10]


def test_hash_split_is_exact_and_stable(spark):
    df = spark.createDataFrame([("c", i) for i in range(20)], "cat string, id long")
    key = F.col("cat"), F.col("id")
    a = {r.id: r.split for r in se.hash_split(df, ["cat"], *key).collect()}
    b = {r.id: r.split for r in se.hash_split(df.orderBy(F.desc("id")).repartition(5), ["cat"], *key).collect()}
    assert a == b
    assert sorted(a.values()) == ["CALIBRATION"] * 3 + ["TRAIN"] * 14 + ["VALIDATION"] * 3


def test_sources_and_sinks(spark, tmp_path):
    p = str(tmp_path / "x.jsonl")
    with open(p, "w", encoding="utf-8") as f:
        f.write('﻿{"k": 1, "v": "a"}\n\n{"k": 2, "v": null}\n')
    df = rec.read_json_lines(spark, p, "k long, v string")
    assert rows(df, "k") == [(1, "a"), (2, None)]
    with open(p, "a", encoding="utf-8") as f:
        f.write("{broken\n")
    bad = rec.read_json_lines(spark, p, "k long, v string", strict=False)
    assert bad.where("_corrupt is not null").count() == 1
    out = str(tmp_path / "out")
    rec.write_json_lines(spark.createDataFrame([(1, None)], "k long, v string"), out)
    assert [r.value for r in spark.read.text(out).collect()] == ['{"k":1,"v":null}']
    assert rec.read_or_empty(spark, str(tmp_path / "none"), "k long").count() == 0
    assert rec.digests(spark, p).first().bytes > 0
    assert rows(rec.require_unique(spark.createDataFrame([(1,), (2,)], "k long"), ["k"]), "k") == [(1,), (2,)]
    try:
        rec.require_unique(spark.createDataFrame([(1,), (1,)], "k long"), ["k"]).collect()
        raise AssertionError("a key twice must fail")
    except Exception as e:  # noqa: BLE001
        assert "there twice" in str(e)


def test_streams_equal_batches(spark, tmp_path):
    data = [(k, t, float((k * 7 + t) % 13)) for k in (1, 2) for t in (1, 2, 3, 9, 10)]
    src = str(tmp_path / "src")
    df = spark.createDataFrame(data, "k long, t long, v double")
    df.where("t <= 3").coalesce(1).write.mode("append").parquet(src)
    df.where("t > 3").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = chunks.smoothed(stream, "k", "t", "v", 2).writeStream.format("memory").queryName("smoothed_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.k, r.t): round(r.smoothed, 9) for r in spark.table("smoothed_rows").collect()}
    want = {(r.k, r.t): round(r.smoothed, 9) for r in sq.smooth(df, ["k"], "t", "v", 2).collect()}
    assert got == want


def test_bootstrap_holds_the_mean(spark):
    df = spark.createDataFrame([(k, float(k % 10)) for k in range(300)], "k long, v double")
    a, b = (se.bootstrap_mean(df.repartition(n), "k", "v", draws=200).first() for n in (2, 5))
    assert a.low < a.mean < a.high
    assert abs(a.low - b.low) < 1e-9


def test_one_outlier_or_a_crowd_makes_no_large_bucket(spark):
    """Values that crowd near 0 beside one of 1e12: buckets hold a tenth of a key's values at most, and quantiles stay exact."""
    rng = np.random.default_rng(8)
    values = np.concatenate((rng.random(40_000) ** 8 * 1e-3, [1e12]))
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), ("b", 3.0), ("b", None)], "k string, v double")
    sizes = me.bucketed(df, "v").where("k = 'a'").groupBy("_at").count().collect()
    assert max(r["count"] for r in sizes) < len(values) / 10 and len(sizes) > 100
    got = {r.k: r for r in me.quantiles(df, ["k"], "v", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    assert np.allclose([got["a"].low, got["a"].mid, got["a"].top], np.quantile(values, [0.1, 0.5, 1.0]), rtol=1e-12)
    assert (got["b"].low, got["b"].mid, got["b"].top) == (1.2, 2.0, 3.0)
    curve = me.curve(df.where("v is not null").withColumn("y", F.col("v") > 1e-4), ["k"], "v", "y").where("k = 'a'").orderBy("v").collect()
    assert curve[0].tp == sum(values > 1e-4) and curve[0].fp == sum(values <= 1e-4) and (curve[-1].tp, curve[-1].fp) == (1, 0)


def test_guarded_crops_equal_a_plain_fold(spark):
    rng, rows, want = np.random.default_rng(9), [], {}
    for mode in ("none", "offset", "canonical"):
        for key in range(6):
            state = None
            for o in np.cumsum(rng.integers(1, 3, 15)).tolist():
                x1, y1 = rng.integers(0, 120), rng.integers(0, 90)
                box = (float(x1), float(y1), float(x1 + rng.integers(1, 41)), float(y1 + rng.integers(1, 31)))
                c = None if rng.random() < 0.1 else (float(rng.integers(0, 320)) / 2, float(rng.integers(0, 240)) / 2)
                rows.append((mode, key, int(o), *(c or (None, None)), *box, 160, 120, 50, 30))
                if c is None:
                    state, want[mode, key, int(o)] = None, (None, None)
                    continue
                fresh = state is None or o - state[2] > 1
                new, place, after = [], [], []
                for k, (whole, size) in enumerate(((160, 50), (120, 30))):
                    s = c[k] if fresh else state[k] + 0.5 * (c[k] - state[k])
                    show = [max(0, min(q + size, box[k + 2]) - max(q, box[k])) for q in range(whole - size + 1)]
                    best = [q for q, v in enumerate(show) if v == max(show)]
                    p = min(max(math.floor(s - size / 2), 0), whole - size)
                    q = min(max(p, best[0]), best[-1])
                    new.append({"none": s, "offset": s + q - p, "canonical": q + size / 2}[mode])
                    place.append(q)
                    after.append(show[q] / (box[k + 2] - box[k]))
                state, want[mode, key, int(o)] = (*new, o), tuple(place)
    df = spark.createDataFrame(rows, "mode string, k int, o long, cx double, cy double, x1 double, y1 double, x2 double, y2 double, fw int, fh int, zw int, zh int")
    got = {}
    for mode in ("none", "offset", "canonical"):
        out = sq.guarded_crops(df.where(F.col("mode") == mode), ["k"], "o", ("cx", "cy"), ("x1", "y1", "x2", "y2"), ("fw", "fh"), ("zw", "zh"), 1, feedback=mode)
        for r in out.collect():
            got[mode, r.k, r.o] = (r.x, r.y)
            assert r.x is None or r.visible_after >= r.visible_before - 1e-12
    assert got == want


def test_losses_of_a_value_of_0_are_those_of_its_sql(spark, tmp_path):
    import duckdb

    from tidemark.plans import metric_queries

    kinds, path = ["purchase", "view"], str(tmp_path / "events.parquet")
    duckdb.execute(f"COPY (SELECT k AS event_id, TIMESTAMP '2024-01-01' + to_seconds(k) AS ts, k // 12 AS user_id, {kinds}[k % 2 + 1] AS event_type, CASE WHEN k IN (3, 16) THEN 0.0 ELSE k * 1.5 END AS value, '' AS props FROM range(36) AS x(k)) TO '{path}' (FORMAT parquet)")
    got = metric_queries.losses(spark, str(tmp_path)).toPandas()
    duckdb.execute(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{path}'")
    want = duckdb.execute(metric_queries.BOOK.sql["losses"]).fetchdf()
    order = lambda x: x[want.columns].sort_values("user_id").to_numpy(float)
    assert np.isinf(order(want)).any() and np.isnan(order(want)).any()
    assert np.allclose(order(got), order(want), atol=1e-6, equal_nan=True)
