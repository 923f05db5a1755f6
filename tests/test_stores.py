"""Stores that only show whole shards, ragged files, nested records, pools, region masks, kernels and padded batches, against plain versions."""

import hashlib
import math
import os
import random
import uuid
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap, nested, pools, regions, selection, sequences, sequences_padded
from tidemark.plans import store_queries
from tidemark.sources import ragged, shards

SF = "/root/testdata/sf0.001"


@pytest.fixture
def place(spark):
    return f"{shards.shared_folder(spark)}/store-{uuid.uuid4().hex}"


def seen(store):
    return sorted((r.k, r.v) for r in store.read().select("k", "v").collect())


def data(spark, n, keys=5):
    return spark.createDataFrame([(f"k{i % keys}", i) for i in range(n)], "k string, v long").repartition(3)


def test_killed_at_every_step_then_resumed(spark, place):
    rows = data(spark, 40)
    want = sorted((r.k, r.v) for r in rows.collect())
    store = shards.ShardStore(spark, place, "k", {"run": 1})
    store.bind()
    store.stage(rows, "a")  # dies before anything is published
    with pytest.raises(shards.ContentError):
        store.read()
    store.stage(rows.where("v < 20"), "b")  # dies between data and status
    assert store.files.move(f"{place}/staging/data-b", f"{place}/data/attempt=b")
    assert store.attempts() == [] and store.pending(rows).count() == 40
    store.write(rows.where("k < 'k2'"))  # ends
    assert {k for k, _ in seen(store)} == {"k0", "k1"}
    assert {r.k for r in store.pending(rows).select("k").distinct().collect()} == {"k2", "k3", "k4"}
    store.write(rows)
    assert seen(store) == want
    store.write(rows)  # nothing is left to do
    assert seen(store) == want and store.status().count() == 5
    assert sorted(store.sweep()) == ["data/attempt=b", "staging/data-a"]
    assert seen(store) == want and store.verify().where("state = 'COMPLETE'").count() == 5


def test_two_writers_of_the_same_shards_show_one(spark, place):
    rows = data(spark, 10)
    store = shards.ShardStore(spark, place, "k", {})
    store.bind()
    for attempt in ("x", "y"):
        store.stage(rows, attempt)
    for attempt in ("y", "x"):
        store.publish(attempt)
    assert len(seen(store)) == 10 and {r.attempt for r in store.status().collect()} == {"x"}
    with pytest.raises((shards.ContentError, Exception)):
        store.publish("x")


def test_another_identity_fails_closed(spark, place):
    rows = data(spark, 4)
    shards.ShardStore(spark, place, "k", {"seed": 1, "model": "m"}).write(rows)
    shards.ShardStore(spark, place, "k", {"model": "m", "seed": 1}).bind()
    with pytest.raises(shards.IdentityError):
        shards.ShardStore(spark, place, "k", {"seed": 2, "model": "m"}).write(rows)
    with pytest.raises(shards.IdentityError):
        shards.ShardStore(spark, place, "k", {"seed": 1, "model": "m"}).write(rows, resume=False)


def test_changed_content_fails_closed(spark, place):
    rows = data(spark, 20)
    store = shards.ShardStore(spark, place, "k", {})
    attempt = store.write(rows)
    rows.withColumn("v", F.when(F.col("v") == 7, 8).otherwise(F.col("v"))).where("k <> 'k3'").write.mode("overwrite").parquet(f"{place}/data/attempt={attempt}")
    assert {(r.k, r.state) for r in store.verify().collect()} == {("k0", "COMPLETE"), ("k1", "COMPLETE"), ("k2", "DIFFERS"), ("k3", "MISSING"), ("k4", "COMPLETE")}
    with pytest.raises(shards.ContentError):
        store.write(rows)


def test_null_keys_and_no_rows(spark, place):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v long")
    store = shards.ShardStore(spark, place, "k", {})
    store.write(rows.limit(0))
    store.write(rows)
    store.write(rows)
    assert store.read().count() == 3 and store.pending(rows).count() == 0


def test_subset_reads_prune_and_are_strict(spark, place):
    shards.write_partitioned(spark.range(1000).select((F.col("id") % 50).alias("video"), F.col("id").alias("v")), place, "video")
    wanted = spark.createDataFrame([(3, "x"), (7, "x"), (3, "y")], "video long, why string")
    some = shards.read_subset(spark, place, wanted.where("why <> 'z'"), "video", strict=False)
    assert {r.video for r in some.collect()} == {3, 7} and some.count() == 40
    assert "dynamicpruning" in some._jdf.queryExecution().toString().lower()
    assert shards.read_subset(spark, place, wanted, "video").count() == 40
    with pytest.raises(Exception, match="no rows of video 99"):
        shards.read_subset(spark, place, wanted.unionByName(spark.createDataFrame([(99, "x")], wanted.schema)), "video").collect()


def test_many_keys_share_folders(spark, place, monkeypatch):
    monkeypatch.setattr(shards, "FOLDERS", 16)
    rows = spark.range(2000).select((F.col("id") % 400).alias("video"), F.col("id").alias("v"))
    shards.write_partitioned(rows, place, "video")
    names = [n for n in os.listdir(place) if "=" in n]
    assert len(names) == 16 and sum(f.endswith(".parquet") for n in names for f in os.listdir(f"{place}/{n}")) <= 64
    wanted = spark.createDataFrame([(3,), (7,), (3,)], "video int")
    for strict in (False, True):
        some = shards.read_subset(spark, place, wanted.where("video <> 5"), "video", strict)
        assert some.columns == ["video", "v"] and sorted(r.v for r in some.collect()) == sorted(v for v in range(2000) if v % 400 in (3, 7))
        assert strict or "dynamicpruning" in some._jdf.queryExecution().toString().lower()
    with pytest.raises(Exception, match="no rows of video 999"):
        shards.read_subset(spark, place, spark.createDataFrame([(3,), (999,)], "video int"), "video").collect()


def test_sample_lookup_names_the_fault(spark):
    samples = spark.createDataFrame([("a", "TRAIN"), ("b", "TRAIN")], "sample_id string, split string")
    raw = spark.createDataFrame([("a", 10), ("b", 20)], "sample_id string, frames int")
    label = spark.createDataFrame([("a", 10), ("b", 21)], "sample_id string, frames int")
    out = shards.sample_lookup(samples, {"raw": raw, "label": label}, "sample_id", "TRAIN", {"raw frames": F.col("raw.frames") > 0})
    assert {(r.sample_id, r.raw.frames, r.label.frames) for r in out.collect()} == {("a", 10, 10), ("b", 20, 21)}
    for tables, split, checks, fault in [
        ({"raw": raw}, "VALIDATION", {}, "split does not hold for"), ({"raw": raw.where("sample_id = 'a'")}, "TRAIN", {}, "no row in raw for b"), ({"raw": raw.union(raw)}, "TRAIN", {}, "two rows in raw"),
        ({"raw": raw, "label": label}, "TRAIN", {"alignment": F.col("raw.frames") == F.col("label.frames")}, "alignment does not hold for b"),
    ]:
        with pytest.raises(Exception, match=fault):
            shards.sample_lookup(samples, tables, "sample_id", split, checks).collect()


def test_ragged_round_trip_and_pruning(spark, place):
    rng = np.random.default_rng(1)
    rows = []
    for v, n in product(["a", "b/ü", "c"], range(7)):
        m = int(rng.integers(0, 4)) if v != "c" else 0
        rows.append((v, n * 3, rng.random((m, 4)).astype("f4").tolist(), rng.random(m).astype("f4").tolist(), rng.integers(0, 9, m).tolist()))
    df = spark.createDataFrame(rows, ragged.SCHEMA)
    ragged.save_ragged(df, place)
    ragged.save_ragged(df, place)  # the same files again
    back = ragged.read_ragged(spark, place)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    some = back.where("video = 'b/ü' and frame >= 6 and frame <= 12 and size(scores) >= 0")
    assert sorted(tuple(r) for r in some.collect()) == sorted(r for r in rows if r[0] == "b/ü" and 6 <= r[1] <= 12)
    reader = ragged.RaggedReader(place)
    left = list(reader.pushFilters([ragged.In(("video",), ("a", "zz")), ragged.GreaterThanOrEqual(("frame",), 3)]))
    assert left == [] and [len(p.paths) for p in reader.partitions()] == [1]
    assert back.where("video in ('a', 'zz')").rdd.getNumPartitions() == 1 and back.where("video = 'none'").count() == 0


def test_ragged_files_are_checked():
    good = ragged.pack(np.array([0, 2]), np.array([0, 1, 1]), np.zeros((1, 4)), np.zeros(1), np.zeros(1))
    assert len(list(ragged.Ragged(good).batches("v"))) == 1
    for bad in (b"", b"RAGGED99" + good[8:], good[:-1], good + b"x"):
        with pytest.raises(ValueError):
            ragged.Ragged(bad)
    for offsets in ([0, 1, 2], [0, 2, 1], [1, 1, 1], [0, 1]):
        with pytest.raises(ValueError):
            ragged.pack(np.array([0, 2]), np.array(offsets), np.zeros((1, 4)), np.zeros(1), np.zeros(1))


def plain_denials(value, path="$"):
    bad = lambda s: s.lower() == "s1" or "recall" in s.lower()
    if isinstance(value, dict):
        for k, v in value.items():
            if bad(k):
                yield f"{path}.{k}", "key"
            yield from plain_denials(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from plain_denials(v, f"{path}[{i}]")
    elif isinstance(value, str) and bad(value):
        yield path, "value"


def test_denials_at_any_depth(spark):
    import json

    deep = "S1"
    for k in range(12):
        deep = {"a": deep} if k % 2 else [k, deep, None]
    rng = random.Random(3)

    def build(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind < 3:
            return rng.choice([1, 2.5, True, None, "x", "S1", "the Recall", "recal"])
        if kind == 3:
            return [build(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["k", "s1", "S1", "recall_at", "m"]) + str(i) * (i > 0): build(depth - 1) for i in range(rng.randrange(4))}

    docs = [deep, [], {}, "s1", 3, {"s1": {"s1": ["s1"]}}, *[build(5) for _ in range(40)]]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(99, None)], "id int, path string").withColumnRenamed("path", "j")
    got = sorted((r.id, r.path, r.what) for r in nested.denied(df, ["id"], "j", ["s1"], ["recall"], ["recall"]).collect())
    assert got == sorted((i, p, w) for i, d in enumerate(docs) for p, w in plain_denials(d))
    with pytest.raises(ValueError, match="forbidden"):
        nested.require_allowed(df, ["id"], "j", ["s1"], ["recall"], ["recall"])
    assert nested.require_allowed(df, ["id"], "j", ["nothing"], [], []) is df
    with pytest.raises(Exception):
        nested.denied(spark.createDataFrame([(1, "{")], "id int, j string"), ["id"], "j", ["s1"], [], []).collect()


def test_denials_take_one_pass_and_refuse_what_is_no_json(spark, monkeypatch):
    df = spark.createDataFrame([(1, '{"a": [{"S1": "Recall x"}, 3]}'), (2, None)], "id int, j string")
    monkeypatch.setattr(nested, "_kept", None)  # no level is written
    got = sorted((r.path, r.what) for r in nested.denied(df, ["id"], "j", ["s1"], [], ["recall"]).collect())
    assert got == [("$.a[0].S1", "key"), ("$.a[0].S1", "value")]
    for text in ('{"a": 1, "a": 2}', "[NaN]", "[1] 2", ""):
        with pytest.raises(Exception):
            nested.denied(spark.createDataFrame([(1, text)], "id int, j string"), ["id"], "j", ["s1"], [], []).collect()
    with pytest.raises(Exception, match="more than 3 levels"):
        nested.denied(spark.createDataFrame([(1, "[[[[[1, []]]]]]")], "id int, j string"), ["id"], "j", ["s1"], [], [], 3).collect()


def plain_pool(items, wanted, cap, most):
    count, taken, out = Counter(), [], {}
    for limit in range(cap, most + 1):
        for name in sorted(wanted):
            for h, i, b, u in sorted(items):
                if b == name and i not in out and sum(1 for t in taken if t == name) < wanted[name] and count[u] < limit:
                    out[i] = limit
                    taken.append(name)
                    count[u] += 1
    return out


def test_pool_equals_the_plain_loop(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").collect()
    items = [(hashlib.sha256(f"7|{o.o_orderkey}".encode()).hexdigest(), o.o_orderkey, o.o_orderpriority, o.o_custkey) for o in orders]
    wanted = pools.shares(len(items) // 4, {"1-URGENT": 0.4, "2-HIGH": 0.3, "3-MEDIUM": 0.2, "5-LOW": 0.1})
    got = {r.o_orderkey: r["round"] for r in store_queries.relaxed_pool(spark, SF).collect()}
    assert got == plain_pool(items, wanted, 3, 20)
    few = [(f"{(i * 7919) % 1009:04d}", i, "ab"[i % 3 == 0], (i * i) % 4 if i % 5 else None) for i in range(80)]
    df = spark.createDataFrame(few, "h string, item long, bin string, user long")
    for wanted, cap, most in [({"a": 30, "b": 20}, 1, 20), ({"a": 40, "b": 5}, 2, 4), ({"b": 100, "zz": 3}, 1, 30), ({"a": 0}, 1, 3)]:
        out = pools.build_pool(df, "item", "bin", "user", "h", wanted, cap, most)
        assert {r.item: r["round"] for r in out.collect()} == plain_pool(few, wanted, cap, most)


def plain_runs(frames):
    out = []
    for f in sorted(frames):
        if out and f == out[-1][-1] + 1:
            out[-1].append(f)
        else:
            out.append([f])
    return out


def plain_cover(frames, areas, budget):
    units = []
    for name, inside in areas.items():
        own = sorted(set(inside) & set(frames))
        if own:
            units.append((sum(frames[f][0] for f in own) / len(own), min(frames[f][1] for f in own), name, own))
    chosen = set()
    for *_, own in sorted(units):
        new, room = set(own) - chosen, budget - len(chosen)
        if len(new) <= room:
            chosen |= new
            continue
        for run in sorted(plain_runs(new), key=lambda r: (-len(r), r[0])):
            q = min(room, len(run))
            chosen |= set(run[(len(run) - q) // 2 :][:q])
            room -= q
    return chosen


def test_region_mask_equals_the_plain_loop(spark):
    rng, rows, areas, want = random.Random(4), [], [], set()
    for key in range(25):
        frames = {f: (rng.randrange(6), 100 * f + key) for f in rng.sample(range(40), rng.randrange(1, 35))}
        starts = [rng.randrange(38) for _ in range(7)]
        regions_of = {r: list(range(s, s + rng.randrange(1, 14))) for r, s in enumerate(starts)} | {9: list(range(40))}
        budget = rng.randrange(0, len(frames) + 1)
        rows += [(key, f, s, t, budget) for f, (s, t) in frames.items()]
        areas += [(key, r, f) for r, fs in regions_of.items() for f in fs]
        want |= {(key, f) for f in plain_cover(frames, regions_of, budget)}
    f = spark.createDataFrame(rows, "key long, frame long, score long, tie long, budget long")
    a = spark.createDataFrame(areas, "key long, region long, frame long")
    got = [tuple(r) for r in regions.region_mask(f, a, ["key"], "frame", "region", "score", "tie", "budget").collect()]
    assert set(got) == want and len(got) == len(want)
    with pytest.raises(Exception, match="less than the budget"):
        regions.region_mask(f.withColumn("budget", F.lit(99)), a, ["key"], "frame", "region", "score", "tie", "budget").collect()


def test_random_interval_has_the_exact_size(spark):
    rng, rows = random.Random(5), []
    for key in range(40):
        frames = rng.sample(range(60), rng.randrange(1, 50))
        rows += [(key, f, rng.randrange(0, len(frames) + 1)) for f in frames]
    df = spark.createDataFrame(rows, "key long, frame long, k long")
    df = df.join(df.groupBy("key").agg(F.first("k").alias("budget")), "key").select("key", "frame", "budget")
    budgets = {r.key: r.budget for r in df.distinct().collect()}
    out = regions.random_interval_mask(df, ["key"], "frame", "budget", bootstrap.slot_hash(F.col("key"), F.col("_run"))).collect()
    frames = {k: [f for kk, f, _ in rows if kk == k] for k in budgets}
    for key, budget in budgets.items():
        got, longest = sorted(r.frame for r in out if r.key == key), max(map(len, plain_runs(frames[key])))
        assert len(got) == budget and set(got) <= set(frames[key])
        if budget:
            assert {r.exact for r in out if r.key == key} == {longest >= budget}
            assert len(plain_runs(got)) == 1 or longest < budget
            if longest < budget:
                for run in plain_runs(frames[key]):
                    n = len(set(run) & set(got))
                    assert abs(n - budget * len(run) / len(frames[key])) < 1


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(6)
    rows = [(f"c{rng.randrange(12)}", "ab"[i % 2], round(rng.random(), 1) if i % 3 else rng.random() ** 6, int(rng.random() < 0.3), i) for i in range(600)]
    return rows, spark.createDataFrame([(*r[:4],) for r in rows], "c string, s string, x double, y int")


def test_pair_kernel_counts_all_pairs(spark, scored):
    rows, df = scored
    clusters = bootstrap.numbered_clusters(df, "c")
    place = {r.c: r.i for r in clusters.collect()}
    want = Counter()
    for (a, _, x, y, _), (b, _, z, w, _) in product(rows, rows):
        if y == 1 and w == 0 and x >= z:
            want[place[a], place[b]] += 1 if x > z else 0.5
    for buckets in (1, 3, 16):
        got = {(r.i, r.j): r.wins for r in bootstrap.pair_kernel(df, clusters, "c", "x", "y", buckets).collect()}
        assert got == dict(want)


def test_kernel_interval_equals_plain_resampling_with_the_same_weights(spark, scored):
    rows, df = scored
    clusters = bootstrap.numbered_clusters(df, "c", "s")
    names = {(r.stratum, r.i): r.c for r in clusters.collect()}
    weights = bootstrap.multinomial(clusters, 30).collect()
    got = {r.stratum: r for r in bootstrap.auc_interval(df, "c", "x", "y", 30, "s").collect()}
    for s in "ab":
        n = sum(1 for k in names if k[0] == s)
        samples = []
        for draw in range(1, 31):
            w = Counter({names[s, r.i]: r.w for r in weights if r.stratum == s and r.draw == draw})
            assert sum(w.values()) == n
            wins = total = 0
            for (a, _, x, y, _), (b, _, z, v, _) in product([r for r in rows if r[1] == s], repeat=2):
                if y == 1 and v == 0:
                    total += w[a] * w[b]
                    wins += w[a] * w[b] * (1 if x > z else 0.5 if x == z else 0)
            samples.append(wins / total)
        assert math.isclose(got[s].low, np.quantile(samples, 0.025)) and math.isclose(got[s].high, np.quantile(samples, 0.975))


def test_kernel_without_a_class_and_too_many_clusters(spark, scored, monkeypatch):
    _, df = scored
    row = bootstrap.auc_interval(df.withColumn("y", F.lit(1)), "c", "x", "y", 5).collect()[0]
    assert (row.auc, row.low, row.high) == (None, None, None)
    monkeypatch.setattr(bootstrap, "CLUSTERS", 3)
    with pytest.raises(Exception, match="at most 3 clusters"):
        bootstrap.auc_interval(df, "c", "x", "y", 5).collect()


def test_clusters_are_numbered_and_slots_made_by_many_tasks(spark, monkeypatch):
    for cast in ("long", "string"):
        df = spark.range(3000).select((F.col("id") % 1000).cast(cast).alias("c"), F.when(F.col("id") % 1000 < 700, "a").otherwise("b").alias("s"))
        got = {(r.s, r.c): (r.i, r.n) for r in bootstrap.numbered_clusters(df.unionByName(spark.createDataFrame([(None, "a")], df.schema)), "c", "s").withColumnRenamed("stratum", "s").collect()}
        values = {s: [None, *sorted(c for t, c in got if t == s and c is not None)] if s == "a" else sorted(c for t, c in got if t == s) for s in "ab"}
        assert got == {(s, c): (i, len(values[s])) for s in "ab" for i, c in enumerate(values[s])} and len(got) == 1001
    monkeypatch.setattr(bootstrap, "SLOTS", 64)
    made = bootstrap.slots(spark.createDataFrame([("a", 1000), ("b", 1), ("c", 64), ("d", 65)], "stratum string, n long"), 3).withColumn("p", F.spark_partition_id())
    by = {(r.stratum, r.draw): (r.low, r.high, r.k) for r in made.groupBy("stratum", "draw").agg(F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("k")).collect()}
    assert by == {(s, d): (1, n, n) for s, n in (("a", 1000), ("b", 1), ("c", 64), ("d", 65)) for d in (1, 2, 3)}
    tasks = [r["count"] for r in made.groupBy("p").count().collect()]
    assert max(tasks) < 0.4 * sum(tasks)


def test_interval_by_score_equals_the_kernel_and_takes_any_number_of_clusters(spark, scored, monkeypatch):
    _, df = scored
    for stratum in (None, "s"):
        want = {r.stratum: r for r in bootstrap.auc_interval(df, "c", "x", "y", 30, stratum).collect()}
        got = {r.stratum: r for r in bootstrap.auc_interval_by_score(df, "c", "x", "y", 30, stratum).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k][c], want[k][c]) for k in want for c in ("auc", "low", "high"))
    row = bootstrap.auc_interval_by_score(df.withColumn("y", F.lit(1)), "c", "x", "y", 5).collect()[0]
    assert (row.auc, row.low, row.high) == (None, None, None)
    monkeypatch.setattr(bootstrap, "CLUSTERS", 3)
    assert store_queries.kernel_auc(spark, SF).count() == 1


def test_crops_go_on_over_batches_without_a_join(spark):
    rng, rows = random.Random(8), []
    for key in range(12):
        for k in sorted(rng.sample(range(60), rng.randrange(1, 50))):
            x, y = rng.randrange(0, 80), rng.randrange(0, 60)
            rows.append((key, k, float(x), float(y), x + rng.randrange(1, 80) + 0.0, y + rng.randrange(1, 60) + 0.0, x + 20.5 if rng.random() < 0.9 else None, y + 9.25))
    df = spark.createDataFrame(rows, "v long, k long, x1 double, y1 double, x2 double, y2 double, cx double, cy double").select("*", *[F.lit(n).alias(c) for c, n in {"fw": 160, "fh": 120, "zw": 60, "zh": 40}.items()])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for feedback in ("none", "offset", "canonical"):
            out = sequences.guarded_crops(df, ["v"], "k", ("cx", "cy"), ("x1", "y1", "x2", "y2"), ("fw", "fh"), ("zw", "zh"), 2, feedback=feedback)
            assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
            got, want, last = {(r.v, r.k): (r.x, r.y, r.reset) for r in out.collect()}, {}, None
            for v, k, x1, y1, x2, y2, cx, cy in rows:
                why = "NEW_KEY" if last is None or last[0] != v else "NO_VALUE" if cx is None else "GAP" if k - last[1] > 2 else "AFTER_NO_VALUE" if last[2] is None else None
                if cx is None:
                    want[v, k], last = (None, None, why), (v, k, None)
                    continue
                state, places = [], []
                for c, size, most, a, b, was in ((cx, 60, 100, x1, x2, 0), (cy, 40, 80, y1, y2, 1)):
                    now = c if why else last[2][was] + 0.5 * (c - last[2][was])
                    shown = [max(0, min(q + size, b) - max(q, a)) for q in range(most + 1)]
                    best = [q for q, o in enumerate(shown) if o == max(shown)]
                    p = min(max(math.floor(now - size / 2), 0), most)
                    q = min(max(p, best[0]), best[-1])
                    places.append(q)
                    state.append({"none": now, "offset": now + (q - p), "canonical": q + size / 2}[feedback])
                want[v, k], last = (*places, why), (v, k, state)
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_knapsacks_of_a_batch_equal_single_ones(monkeypatch, spark):
    rng, rows = random.Random(7), []
    for key in range(200):
        rows += [(key, i, rng.randrange(0, 9), float(rng.randrange(0, 5))) for i in range(rng.randrange(1, 9))]
    monkeypatch.setattr(selection, "KNAPSACK_CELLS", 500)
    got = selection.within_budget(spark.createDataFrame(rows, "k long, i long, w long, v double"), "k", "i", "w", "v", 40).collect()
    want = set()
    for key in range(200):
        own = [r for r in rows if r[0] == key]
        w, v = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        want |= {(key, i) for i in selection.knapsack(w, v, int(w.sum() * 40 // 100))}
    assert {tuple(r) for r in got} == want


def test_shot_summaries_equal_the_plain_chain(spark):
    import itertools

    got = Counter((r.seq, r.first, r.end) for r in store_queries.shot_summaries(spark, SF).collect())
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("embedding is not null").collect()
    groups = {}
    for r in sorted(e, key=lambda r: r.vec_id):
        groups.setdefault(f"{r.label}|{r.vec_id >> 6}", []).append(r)
    want, compared = Counter(), 0
    for seq, rows in groups.items():
        starts = [0, *selection.change_points(np.array([r.embedding for r in rows], float), 8)]
        frames = [r.vec_id % 64 * 15 for r in rows] + [960]
        spans = [b - a for a, b in zip(frames, frames[1:])]
        scores = [float(r.embedding[0]) ** 2 + 0.01 for r in rows]
        shots = []
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            length = frames[b] - frames[a]
            shots.append((frames[a], frames[b], length, sum(s * n for s, n in zip(scores[a:b], spans[a:b])) / length))
        best = max(itertools.product([0, 1], repeat=len(shots)), key=lambda c: sum(s[3] for s, x in zip(shots, c) if x) if sum(s[2] for s, x in zip(shots, c) if x) <= 144 else -1)
        want.update((seq, s[0], s[1]) for s, x in zip(shots, best) if x)
        compared += 1
    assert got == want and compared > 50


def test_shots_out_of_order_are_refused(spark):
    rows = spark.createDataFrame([("k", 0, [0.0], 1.0, 5, 9), ("k", 1, [1.0], 1.0, 5, 9)], "k string, o int, v array<double>, s double, f long, n long")
    with pytest.raises(Exception, match="do not rise"):
        selection.shot_summary(rows, "k", "o", "v", "s", "f", "n", 3).collect()


def test_padded_batches(spark):
    rows = [(k, t, k * 100 + t) for k in range(50) for t in range(1 + k % 20)]
    df = spark.createDataFrame(rows, "k long, t long, v long").repartition(4)
    out = sequences_padded.padded_batches(df, "k", ["t"], {"v": -1}, 8).collect()
    assert {r.k for r in out} == set(range(50))
    for r in out:
        n = 1 + r.k % 20
        assert r.bucket == (8 if n <= 8 else 16 if n <= 16 else 32) and r.length == n
        assert r.v == [r.k * 100 + t for t in range(n)] + [-1] * (r.bucket - n)
        assert r["mask"] == [True] * n + [False] * (r.bucket - n) and sum(r["last"]) == n - 1
    sizes = Counter((r.bucket, r.batch) for r in out)
    assert max(sizes.values()) <= 8 and len({(r.bucket, r.batch, r.place) for r in out}) == 50


def test_feature_row(spark):
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(0.7, float("nan"), 3), (0.5, 1.0, None)], "a double, b double, c int")
    out = [r.x for r in df.select(sequences_padded.feature_row({"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, names, {"a"}).alias("x")).collect()]
    assert out[0]["values"] == [1.0, 0.0, 3.0, 0.0] and out[0]["missing"] == [False, True, False, True]
    assert out[1]["values"] == [0.0, 1.0, 0.0, 0.0] and out[1]["missing"] == [False, False, True, True]
    with pytest.raises(ValueError):
        sequences_padded.feature_row({"z": F.col("a")}, names, set())


def test_text_vectors_equal_the_plain_version(spark):
    got = {(r.conv_id, r.turn): r.vector for r in store_queries.text_vectors(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        clean, want = " ".join((r.text or "").split())[:400], np.zeros(128)
        for n in (2, 3):
            for k in range(len(clean) - n + 1):
                want[int.from_bytes(hashlib.blake2b(f"{n}:{clean[k : k + n]}".encode(), digest_size=8).digest(), "big") % 128] += 1
        want = want / np.linalg.norm(want) if want.any() else want
        assert np.allclose(got[r.conv_id, r.turn], want, atol=1e-6)
