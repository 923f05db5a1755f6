"""Near-duplicate embeddings over a robust-pruned flat graph.

Equal vectors are one representative with a count. Centroids are fitted to a bounded sample; every representative goes to its
``overlap`` nearest clusters, so clusters are overlapping shards. In each shard a graph is built: near neighbours are the
candidates of a vector, and a candidate is pruned if a kept neighbour is nearer to it by the factor ``alpha``. The adjacency
lists that a vector has in its shards are united and sent back to all of them. Then every vector searches each of its
shards greedily from itself, the medoid, and an entry of each unconnected part and each group of linked vectors, and expands all
that it finds in range (and ``margin`` beyond) until nothing new is in range. What is found is verified by the cosine in double precision.

Clusters of more than ``shard`` vectors are cut into pieces by id, each with a graph of its own, and each pair of pieces is
a task, so no task holds more than two pieces. Links of a pair are counted in the first cluster that both are in, both ways
at once; for components only a spanning forest leaves a task. An audit holds the counts of ``audited`` vectors, chosen by
hash, against all vectors in blocks. As many of them (at most a fiftieth of all, ten at least) have a twin: a vector at a cosine between
``least`` and 1 that goes through the search like any other, counts for nothing and joins nothing, so that there are always links to find,
however rare they are in the table. The mean share of links found must reach ``recall``, with equal weight for vectors and with equal weight
for groups. ``overlap`` is doubled before anything is built while fewer twins share a cluster with their vector than half way from ``recall`` to 1;
if the audit fails all the same, everything is built again with twice the overlap, and where that cannot help (``most_overlap``, or no more clusters), all
pairs are compared in blocks.

Results for odd input: vectors that are null, zero or hold null or non-finite components, and vectors of another length than the commonest,
link with nothing and stand alone; a null vec_id stands alone with a null component; rows that repeat a vec_id count as other vectors;
an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Unit vectors from binary float64 rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def _unit(size: int):
    """(row, embedding) to (row, v): bytes of the unit vector, null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("embedding"):
                v = None
                if x.is_valid and len(x.values) == size and not x.values.null_count:
                    raw = np.asarray(x.values, np.float64)
                    top = np.abs(raw).max()
                    if np.isfinite(top) and top > 0:
                        raw = raw / top
                        v = (raw / np.sqrt(raw @ raw) + 0.0).tobytes()
                out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "v"])

    return run


def centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means of the bounded sample."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[k : k + 4096] @ c.T).argmax(axis=1) for k in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-12)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, overlap: int) -> np.ndarray:
    return np.sort(np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :overlap], axis=1).astype(np.int32)


def meeting(x: np.ndarray, y: np.ndarray, c: np.ndarray, overlap: int) -> float:
    """Share of the vectors that have a cluster in common with their twin."""
    return float((nearest(x, c, overlap)[:, :, None] == nearest(y, c, overlap)[:, None, :]).any(axis=(1, 2)).mean())


def _assign(c: np.ndarray, overlap: int):
    """(rep, v, n) to a row for each of the nearest clusters, with all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), c.shape[1])
            near = nearest(x, c, overlap)
            k = near.shape[1]
            row = pa.array(np.repeat(np.arange(len(x)), k))
            lists = pa.ListArray.from_arrays(np.arange(0, len(near) * k + 1, k, dtype=np.int32), near.ravel()).take(row)
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), batch.column("rep").take(row), batch.column("v").take(row), batch.column("n").take(row), lists], ["cluster", "rep", "v", "n", "clusters"])

    return run


def robust_prune(sims: np.ndarray, degree: int, alpha: float, width: int = 64) -> list[np.ndarray]:
    """Neighbours of each of the vectors with these cosines; distances are 1 - cosine.

    Candidates are the ``width`` nearest and, beyond them, some at each scale of rank up to the farthest, taken from near to far; each one
    kept prunes those that it is nearer to by ``alpha``.
    """
    n = len(sims)
    width = min(width, n - 1)
    if width <= 0:
        return [np.zeros(0, np.int32)] * n
    masked = sims.copy()
    np.fill_diagonal(masked, -2.0)
    ranks = np.concatenate((np.arange(width), np.geomspace(width, n - 2, 32).astype(np.int64) if n - 2 >= width else np.zeros(0, np.int64)))
    near = np.argsort(-masked, axis=1, kind="stable")[:, np.unique(ranks)]
    own = 1 - np.take_along_axis(masked, near, axis=1)
    alive, kept = np.ones(near.shape, bool), np.zeros(near.shape, bool)
    rows = np.arange(n)
    for _ in range(degree):  # all vectors take their nearest live candidate at once
        has = alive.any(axis=1)
        if not has.any():
            break
        first = alive.argmax(axis=1)
        kept[rows[has], first[has]] = True
        chosen = near[rows, first]
        between = 1 - sims[chosen[:, None], near]
        alive &= ~(alpha * between <= own)
        alive[rows, first] = False
    back: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(*np.nonzero(kept), strict=True):
        back[near[a, b]].append(a)
    return [np.unique(np.concatenate((near[i][kept[i]], np.array(back[i], np.int64)))).astype(np.int32) for i in range(n)]


def _graph(size: int, degree: int, alpha: float):
    def run(table: pa.Table) -> pa.Table:
        x, reps = _matrix(table.column("v").combine_chunks(), size), table.column("rep").to_numpy()
        order = np.argsort(reps, kind="stable")
        x, reps = x[order], reps[order]
        lists = robust_prune(x @ x.T, degree, alpha)
        return pa.table({"rep": reps, "near": pa.array([reps[k] for k in lists], pa.list_(pa.int64()))})

    return run


def entries(x: np.ndarray, lists: list[np.ndarray], least: float) -> np.ndarray:
    """The medoid, one node of each unconnected part, and one of each group of neighbours of cosine >= ``least``."""
    a, b = np.repeat(np.arange(len(x)), [len(k) for k in lists]), np.concatenate(lists).astype(np.int64)
    near = (x[a] * x[b]).sum(axis=1) >= least
    return np.unique(np.concatenate(([(x @ x.sum(axis=0)).argmax()], _roots(len(x), a, b), _roots(len(x), a[near], b[near])[a[near]])))


def range_search(x: np.ndarray, lists: list[np.ndarray], query: np.ndarray, start: int | np.ndarray, least: float, margin: float, beam: int) -> np.ndarray:
    """Nodes of cosine >= ``least`` found from ``start``: a greedy walk of width ``beam``, then all in range and ``margin`` beyond are expanded."""
    sims = np.full(len(x), -2.0)
    seen, done = np.zeros(len(x), bool), np.zeros(len(x), bool)
    new = np.unique(start)
    while True:
        seen[new] = True
        sims[new] = x[new] @ query
        have = np.flatnonzero(seen)
        best = have if len(have) <= beam else have[np.argpartition(-sims[have], beam - 1)[:beam]]
        front = np.union1d(best, have[sims[have] >= least - margin])
        front = front[~done[front]]
        if not len(front):
            return np.flatnonzero(sims >= least)
        done[front] = True
        new = np.unique(np.concatenate([lists[k] for k in front]))
        new = new[~seen[new]]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _links(size: int, least: float, margin: float, beam: int, exact: bool):
    """Rows of one pair of pieces to (rep, links, root): links counted here, and the least rep that is linked here."""

    def side(table: pa.Table, piece: int):
        t = table.filter(pa.array(table.column("piece").to_numpy() == piece)).sort_by("rep")
        x, reps = _matrix(t.column("v").combine_chunks(), size), t.column("rep").to_numpy()
        lists = []
        for near in [] if exact else t.column("near"):
            ids = np.asarray(near.values, np.int64)
            at = np.searchsorted(reps, ids)
            at = np.minimum(at, len(reps) - 1)
            lists.append(at[reps[at] == ids])
        return t, x, reps, lists

    def run(table: pa.Table) -> pa.Table:
        i, j, cluster = (table.column(c)[0].as_py() for c in ("i", "j", "cluster"))
        left = side(table, i)
        right = left if i == j else side(table, j)
        found = np.zeros((len(left[2]), len(right[2])), bool)
        if found.size and exact:
            found = left[1] @ right[1].T >= least - 1e-9
        elif found.size:
            for near, far, flip in [(left, right, False)] + ([(right, left, True)] if i != j else []):
                start = entries(far[1], far[3], least)
                for k, q in enumerate(near[1]):
                    hits = range_search(far[1], far[3], q, np.append(start, k) if i == j else start, least - 1e-9, margin, beam)
                    if flip:
                        found[hits, k] = True
                    else:
                        found[k, hits] = True
            if i == j:
                found |= found.T
        a, b = np.nonzero(found)
        reps_a, reps_b = left[2], right[2]
        keep = (left[1][a] * right[1][b]).sum(axis=1) >= least if len(a) else np.zeros(0, bool)
        keep &= reps_a[a] != reps_b[b]
        a, b = a[keep], b[keep]
        first = np.array(left[0].column("clusters").to_pylist(), np.int64).reshape(len(reps_a), -1)
        second = np.array(right[0].column("clusters").to_pylist(), np.int64).reshape(len(reps_b), -1)
        mine = np.ones(len(a), bool)
        for k in range(first.shape[1]):  # clusters are in order: no earlier one is common to both
            c = first[a, k]
            mine &= ~((c < cluster) & (second[b] == c[:, None]).any(axis=1))
        n_a, n_b = left[0].column("n").to_numpy(), right[0].column("n").to_numpy()
        count_a = np.bincount(a[mine], n_b[b[mine]], len(reps_a)).astype(np.int64)
        nodes = np.concatenate((reps_a, reps_b))
        joins = (n_a[a] > 0) & (n_b[b] > 0)
        root = nodes[_roots_of(nodes, a[joins], b[joins] + len(reps_a))]
        if i == j:
            return pa.table({"rep": reps_a, "links": count_a, "root": np.minimum(root[: len(reps_a)], root[len(reps_a) :])})
        count_b = np.bincount(b[mine], n_a[a[mine]], len(reps_b)).astype(np.int64)
        return pa.table({"rep": nodes, "links": np.concatenate((count_a, count_b)), "root": root})

    return run


def _roots_of(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Position of the least node of each component; positions are ranked by node first."""
    order = np.argsort(nodes, kind="stable")
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    return order[_roots(len(nodes), rank[a], rank[b])[rank]]


def _count_all(queries: np.ndarray, ids: np.ndarray, least: float):
    """Blocks of (rep, v, n) to (rep, links, others): what each audited vector links with in them, and how many other vectors that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, others = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for batch in batches:
            x, reps, n = _matrix(batch.column("v"), queries.shape[1]), batch.column("rep").to_numpy(), batch.column("n").to_numpy()
            for k in range(0, len(ids), 512):
                at = slice(k, k + 512)
                hit = (queries[at] @ x.T >= least) & (ids[at, None] != reps[None, :])
                links[at] += hit @ n
                others[at] += hit.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(others)], ["rep", "links", "others"])

    return run


def twins(ids: np.ndarray, x: np.ndarray, least: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors at cosines from just above ``least`` to near 1 of the given unit vectors."""
    rng = np.random.default_rng(seed)
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1)[:, None] * x
    size = np.linalg.norm(aside, axis=1)
    aside /= np.maximum(size, 1e-300)[:, None]
    cos = np.where(size > 1e-9, least + (1 - least) * (0.02 + 0.9 * rng.random(len(x))), 1.0)
    out = cos[:, None] * x + np.sqrt(1 - cos * cos)[:, None] * aside
    with np.errstate(over="ignore"):
        names = ids * np.int64(0x1E3779B97F4A7C15) ^ np.int64(0x2545F4914F6CDD1D)
    return names, out / np.linalg.norm(out, axis=1)[:, None]


def _truth(reps: DataFrame, queries: np.ndarray, ids: np.ndarray, least: float) -> dict[int, tuple[int, int]]:
    """Links and linked vectors of those of the given vectors that have any."""
    found = reps.select("rep", "v", "n").mapInArrow(_count_all(queries, ids, least), "rep long, links long, others long")
    found = found.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("others").alias("others")).where("others > 0")
    return {r.rep: (r.links, r.others) for r in found.collect()}  # a row for each audited vector at most


def audit_share(truth: dict[int, tuple[int, int]], got: dict[int, int]) -> float:
    """Share of the links found: the lesser of the means over vectors and over groups, a group being a vector and what it links with."""
    if not truth:
        return 1.0
    share = np.array([min(got.get(r, 0) / n, 1.0) for r, (n, _) in truth.items()])
    group = np.array([1 / (1 + others) for _, others in truth.values()])
    return float(min(share.mean(), share @ group / group.sum()))


def near_vectors(vectors: DataFrame, least: float = 0.95, shard: int = 1_500, overlap: int = 2, degree: int = 24, alpha: float = 1.2, margin: float = 0.1, beam: int = 32, sample: int = 65_536, audited: int = 400, recall: float = 0.98, most_overlap: int = 8) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of ``vectors`` (vec_id, embedding).

    Centroids are fitted to at most ``sample`` vectors, so at most ``sample`` / 16 clusters; beyond that clusters have more pieces.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    common = vectors.where("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = common["size"] if common else 1
    base = written(vectors.mapInArrow(_unit(size), "vec_id long, v binary"))
    reps = written(base.where("v is not null and vec_id is not null").groupBy("v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n")).select(F.xxhash64("v", "low").alias("rep"), "v", "low", "n"))
    count = reps.count()
    links = None
    if count > 1:
        some = [r.v for r in reps.select("v").orderBy(F.xxhash64("rep"), "rep").limit(min(sample, max(4_096, count // 8))).collect()]
        points = np.frombuffer(b"".join(some), np.float64).reshape(-1, size)
        rows = reps.orderBy(F.xxhash64("rep", F.lit(7)), "rep").limit(audited).select("rep", "v").collect()
        ids, chosen = np.array([r.rep for r in rows], np.int64), np.frombuffer(b"".join(r.v for r in rows), np.float64).reshape(-1, size)
        some = min(len(ids), max(10, count // 50))
        names, made = twins(ids[:some], chosen[:some], least)
        truth = _truth(reps, np.concatenate((chosen, made)), np.concatenate((ids, names)), least)
        own = reps.sparkSession.createDataFrame([(int(i), x.tobytes(), 0) for i, x in zip(names, made, strict=True)], "rep long, v binary, n long")
        searched = reps.select("rep", "v", "n").unionByName(own)
        while True:
            k = int(min(len(points) // 16 + 1, max(1, overlap * count // (shard // 2))))
            c = centroids(points, k)
            wider = 2 * overlap <= min(most_overlap, len(c))
            if wider and meeting(chosen[:some], made, c, overlap) < (1 + recall) / 2:
                overlap *= 2
                continue
            links = written(_search(searched, c, min(overlap, len(c)), size, least, shard, degree, alpha, margin, beam))
            asked = reps.sparkSession.createDataFrame([(r,) for r in truth], "rep long")
            got = {r.rep: r.links for r in links.join(F.broadcast(asked), "rep").groupBy("rep").agg(F.sum("links").alias("links")).collect()}  # at most twice ``audited`` rows
            if audit_share(truth, got) >= recall:
                links = links.join(F.broadcast(own.select("rep")), "rep", "left_anti")  # at most ``audited`` rows
                break
            overlap *= 2
            if overlap > min(most_overlap, len(c)):
                links = written(_search(reps, points[:1], 1, size, least, shard, degree, alpha, margin, beam, exact=True))
                break
    rep_rows = reps.select("rep", "v", "low", "n")
    if links is not None:
        label = components(links.where("root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b")))
        names = reps.select(F.col("rep").alias("node"), "low")
        whole = label.join(names, "node").groupBy("component").agg(F.min("low").alias("least"))
        label = label.join(whole, "component").select(F.col("node").alias("rep"), "least")
        counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
        rep_rows = rep_rows.join(counts, "rep", "left").join(label, "rep", "left")
    else:
        rep_rows = rep_rows.withColumn("links", F.lit(0)).withColumn("least", F.col("low"))
    found = rep_rows.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "low").alias("least"))
    out = base.join(found, "v", "left").withColumn("own", F.col("vec_id").isNotNull())
    component = F.when(F.col("own"), F.coalesce("least", "vec_id"))
    return out.select("vec_id", F.when(F.col("own"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _search(reps: DataFrame, c: np.ndarray, overlap: int, size: int, least: float, shard: int, degree: int, alpha: float, margin: float, beam: int, exact: bool = False) -> DataFrame:
    members = written(reps.select("rep", "v", "n").mapInArrow(_assign(c, overlap), "cluster int, rep long, v binary, n long, clusters array<int>"))
    pieces = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("m"))
    cut = members.join(F.broadcast(pieces), "cluster").withColumn("piece", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("m")).cast("int"))  # a row for each cluster: at most sample / 16
    if exact:
        placed = cut.withColumn("near", F.lit(None).cast("array<long>"))
    else:
        lists = cut.groupBy("cluster", "piece").applyInArrow(_graph(size, degree, alpha), "rep long, near array<long>")
        placed = cut.join(written(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))), "rep")
    others = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.least("piece", j).alias("i"), F.greatest("piece", j).alias("j")))
    tasks = placed.select("cluster", "piece", "rep", "v", "n", "clusters", "near", F.explode(others).alias("t")).select("*", "t.i", "t.j").drop("t")
    return tasks.groupBy("cluster", "i", "j").applyInArrow(_links(size, least, margin, beam, exact), "rep long, links long, root long")
