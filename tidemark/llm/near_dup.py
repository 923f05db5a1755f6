"""Near-duplicate groups of documents by a chosen-path set similarity join.

Every document becomes a set of word shingles with minwise tokens at POSITIONS places. Documents with
one and the same set fall into a class first, so that copies cost one row. Then:

1. Independent trees branch the classes. A node chooses places by its own hash, 1/threshold of them on
   average, and a class goes to one child for each chosen place, named by its minwise token there:
   similar classes keep meeting while others part. Nodes of up to ``leaf`` classes are compared whole,
   on two bits of every token, in one task; larger ones branch on, and what is still larger at ``depth``
   is compared in blocks of ``leaf`` against ``leaf``, so that no node is given up.
2. A node reports a spanning forest of its candidates (pairs whose tokens agree as often as those of a
   pair at the threshold less four standard deviations), likeliest pairs first: at most a row for each
   member, however many pairs are alike.
3. The pairs of the forests are confirmed on full sets. Candidates that the forests connect form a
   cluster; where it still holds several confirmed groups, all its candidate pairs between different
   groups are confirmed in blocks, the members of the largest group against the others only.

So a group of many near copies costs rows in proportion to its size, not pairs, and every pair that
meets in any node of any tree is decided on full sets or already lies in one group.

Recall of a pair exactly at the threshold (a share of it is lost, more similar pairs are safer): never
meeting below a root, 2e-9 with 20 trees; agreement four deviations too low, 3e-5; where it meets in
crowded nodes only, 3e-6 at the second and 9e-5 at the third level. A lost pair costs a link only if no
other links connect its two documents.

Results for odd input: null or blank texts have no shingles and stand alone; a null doc_id stands alone
with a null component; each row is judged by its own text, so rows that repeat a doc_id with one text share
a component, and with other texts each row has the component of its text, in which the doc_id counts
like any other. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, partitions, roots, written
from .words import mix, shingle_set

POSITIONS = 256
#: Bits of each token that nodes compare.
BITS = 2
#: Members of a block of a cluster.
BLOCK = 512
_RNG = np.random.default_rng(20240611)
_MUL = _RNG.integers(0, 1 << 31, POSITIONS, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, POSITIONS, np.uint32)
_PLACES = np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least hash of the set under each of POSITIONS hash functions."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(POSITIONS, np.uint32((1 << 32) - 1))
    for at in range(0, len(x), 256):
        np.minimum(out, (x[at : at + 256][None, :] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=out)
    return out


def brief(tokens: np.ndarray) -> np.ndarray:
    """A byte of each token, to which all of its bits count: that a token is a least one says nothing of it."""
    return ((tokens * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def least_agreement(threshold: float) -> float:
    """Share of equal bits, as an estimate of the similarity, four standard deviations below the threshold."""
    t = threshold
    deviation = ((4 * t + 1.5 * (1 - t) - (1 + t) ** 2) / POSITIONS) ** 0.5
    return t - 4 * deviation


def _chosen(nodes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``nodes`` and the places that they choose."""
    return np.nonzero(mix(nodes[:, None] ^ _PLACES[None, :]) <= np.uint64(int(2**64 / (threshold * POSITIONS)) - 1))


def _child(nodes: np.ndarray, places: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(mix(nodes + _PLACES[places]) ^ tokens.astype(np.uint64)).view(np.int64)


def _print(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets(size: int, threshold: float, trees: int):
    """Rows of texts to set size, fingerprint, tokens (a byte each), their first bits, and the first nodes."""
    starts = mix(np.arange(1, trees + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, place = _chosen(starts, threshold)
        for batch in batches:
            n, prints, tokens, bits, nodes = [], [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), size)
                n.append(len(s))
                if not len(s):
                    for out in (prints, tokens, bits, nodes):
                        out.append(None)
                    continue
                full = sketch(s)
                low = brief(full)
                prints.append(_print(s))
                tokens.append(low.tobytes())
                bits.append(np.packbits(np.concatenate([(low >> k) & 1 for k in range(BITS)])).tobytes())
                nodes.append(_child(starts[tree], place, full[place]))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(tokens, pa.binary()), pa.array(bits, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "print", "tokens", "bits", "nodes"])

    return run


def _branch(threshold: float):
    """Rows (node, id, n_shingles, bits, tokens) of nodes that branch on to rows of their children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                nodes = batch.column("node").to_numpy().view(np.uint64)
                table = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint8).reshape(-1, POSITIONS)
                row, place = _chosen(nodes, threshold)
                child = _child(nodes[row], place, table[row, place])
                out = batch.select(["id", "n_shingles", "bits"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(child), *out.columns], ["node", "id", "n_shingles", "bits"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """The rows of a partition sorted by ``key``, in tables of ``rows`` or more that hold whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        at = 0
        for start in starts:
            if start - at >= rows:
                yield table.slice(at, start - at)
                at = start
        if len(starts) and starts[-1] > at:
            yield table.slice(at, starts[-1] - at)
            at = starts[-1]
        held = table.slice(at).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _alike(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows a < b of one group, of different sides where the group has two, that may be linked, the likeliest first, with their agreement.

    A group of two sides is a block pair of which each block is compared within itself elsewhere.
    """
    lo = least_agreement(percent / 100)
    keys, n = table.column("group").to_numpy(), table.column("n_shingles").to_numpy()
    side = table.column("side").to_numpy() if "side" in table.column_names else np.full(len(n), -1)
    label = table.column("label").to_numpy() if "label" in table.column_names else np.arange(len(n))
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(len(n), -1)
    signs = np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1
    ends = np.searchsorted(keys, keys, side="right")
    found = []
    for at in range(0, len(n), 256):
        to = min(at + 256, len(n))
        last = int(ends[to - 1])
        agree = signs[at:to] @ signs[at:last].T / np.float32(signs.shape[1])
        x, y = np.nonzero(agree >= lo)
        x, y, score = x + at, y + at, agree[x, y]
        keep = (x < y) & (keys[x] == keys[y]) & (label[x] != label[y]) & ((side[x] < 0) | (side[x] != side[y]))
        keep &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        found.append((x[keep], y[keep], score[keep]))
    a, b, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(-score, kind="stable")
    return a[order], b[order], score[order]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of a spanning forest in the edges (a, b), earlier edges first: each tree takes its earliest edge, again and again."""
    label, at, chosen = np.arange(n), np.arange(len(a)), []
    while len(at):
        x, y = label[a[at]], label[b[at]]
        apart = x != y
        at, x, y = at[apart], x[apart], y[apart]
        if not len(at):
            break
        _, first = np.unique(np.stack([x, y], axis=1), return_index=True)
        first = np.unique(first // 2)
        chosen.append(at[first])
        label = roots(x[first], y[first], n)[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _forests(percent: int):
    """Rows (group, id, n_shingles, bits[, side]), sorted by group, to the candidate pairs (a, b) of a spanning forest of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "group", 256):
            a, b, _ = _alike(table, percent)
            pick = forest(a, b, table.num_rows)
            ids = table.column("id").to_numpy()
            x, y = ids[a[pick]], ids[b[pick]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    """Keeps the pairs (a, b) whose sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column(c)] for c in ("set_a", "set_b"))
            keep = [_linked(x, y, percent) for x, y in zip(*sets, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _rest(percent: int):
    """Rows (group, side, id, label, n_shingles, bits, set), sorted by group, to the links (a, b) that join different labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "group", 1):
            a, b, _ = _alike(table, percent)
            ids = table.column("id").to_numpy()
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("set")]
            _, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
            top = list(range(int(label.max()) + 1))

            def find(x: int) -> int:
                while top[x] != x:
                    top[x] = x = top[top[x]]
                return x

            out = []
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                p, q = find(int(label[x])), find(int(label[y]))
                if p != q and _linked(sets[x], sets[y], percent):
                    top[max(p, q)] = min(p, q)
                    out.append((ids[x], ids[y]))
            pairs = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _own_sets(size: int):
    """Rows (id, text, print) to (id, set), where the text is that of the fingerprint; other texts of the same doc_id go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = [], []
            for i, text, of in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("print").to_pylist(), strict=True):
                s = shingle_set(text.as_py(), size)
                if len(s) and _print(s) == of:
                    ids.append(i)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "set"])

    return run


def _sorted(rows: DataFrame) -> DataFrame:
    """``rows`` with whole groups in a part, one after another."""
    return rows.repartition("group").sortWithinPartitions("group")


def _blocks(rows: DataFrame, key: str, own: str, inner: str, outer: str) -> DataFrame:
    """Each row once for each pair of blocks that it stands in, with the columns group and side.

    ``own`` is the row's block. The first ``inner`` blocks of a key are compared with themselves and with all;
    the other ``outer`` ones with those only.
    """
    x, k, m = F.col(own), F.col(inner), F.col(inner) + F.col(outer)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(x < k, m).otherwise(k) - 1)))
    i, j = F.least(x, F.col("other")), F.greatest(x, F.col("other"))
    return rows.withColumn("group", F.xxhash64(key, i, j)).withColumn("side", F.when(i == j, -1).otherwise((x == i).cast("int")).cast("long"))


def _candidates(classes: DataFrame, percent: int, leaf: int, depth: int, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Distinct candidate pairs (a, b): the spanning forests of all nodes of all trees."""
    out = None
    rows = classes.select(F.explode("nodes").alias("node"), "id")
    for level in range(depth):
        met = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = rows.join(met, "node")
        if level == 0:
            shared = shared.join(classes.select("id", "n_shingles", "bits"), "id")
        shared = written(shared.select("node", "n", "id", "n_shingles", "bits"))
        small, large = shared.where(F.col("n") <= leaf).withColumn("group", F.col("node")).withColumn("side", F.lit(-1).cast("long")), shared.where(F.col("n") > leaf)
        end = level == depth - 1 or large.isEmpty()
        if end:
            count = F.ceil(F.col("n") / leaf).cast("long")
            large = large.withColumns({"own": F.pmod(F.xxhash64("id"), count), "inner": count, "outer": F.lit(0).cast("long")})
            rest = _blocks(large, "node", "own", "inner", "outer")
            small = small.unionByName(rest.select(*small.columns))
        pairs = _sorted(small.select("group", "side", "id", "n_shingles", "bits")).mapInArrow(_forests(percent), "a long, b long").distinct()
        out = written(pairs if out is None else out.unionAll(pairs).distinct())
        if end:
            return out
        rows = large.join(classes.select("id", "tokens"), "id").select("node", "id", "n_shingles", "bits", "tokens").mapInArrow(_branch(percent / 100), "node long, id long, n_shingles long, bits binary")
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, trees: int = 20, leaf: int = 4096, depth: int = 3) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs`` (doc_id, text).

    Links documents whose sets of ``size``-word shingles overlap in ``percent`` of their union.
    """
    made: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        made.append(written(df))
        return made[-1]

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = docs.mapInArrow(_sets(size, percent / 100, trees), "doc_id long, n_shingles long, print binary, tokens binary, bits binary, nodes array<long>")
    base = kept(sets.withColumn("id", F.monotonically_increasing_id()))
    named = kept(base.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("id").alias("id"), F.min("doc_id").alias("rep")))
    classes = base.drop("print", "doc_id").join(named.select("id"), "id", "left_semi")

    pairs = _candidates(classes, percent, leaf, depth, kept)
    cluster = components(pairs).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    wanted = named.join(cluster, "id").select("id", "print", F.col("rep").alias("doc_id"))
    found = docs.join(wanted, "doc_id").select("id", "text", "print").mapInArrow(_own_sets(size), "id long, set binary")
    shingles = kept(found.repartition(partitions(docs.sparkSession), "id").dropDuplicates(["id"]))

    side = lambda c: shingles.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}"))
    links = kept(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long"))
    label = components(links).select(F.col("node").alias("id"), F.col("component").alias("label"))

    members = kept(cluster.join(label, "id", "left").select("id", "cluster", F.coalesce("label", "id").alias("label")))
    by_label = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = by_label.groupBy("cluster").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    count = lambda n: F.ceil(n / BLOCK).cast("long")
    sizes = sizes.select("cluster", F.col("most.label").alias("main"), count(F.col("n") - F.col("most.n")).alias("inner"), count(F.col("most.n")).alias("outer"))
    rows = members.join(sizes, "cluster")
    hashed = F.xxhash64("id")
    own = F.when(F.col("label") == F.col("main"), F.col("inner") + F.pmod(hashed, F.col("outer"))).otherwise(F.pmod(hashed, F.col("inner")))
    rows = rows.withColumn("own", own).join(classes.select("id", "n_shingles", "bits"), "id").join(shingles, "id")
    rows = _blocks(rows, "cluster", "own", "inner", "outer").select("group", "side", "id", "label", "n_shingles", "bits", "set")
    more = kept(_sorted(rows).mapInArrow(_rest(percent), "a long, b long"))

    label = components(links.unionAll(more)).select(F.col("node").alias("id"), F.col("component").alias("label"))
    of_class = named.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = of_class.groupBy("label").agg(F.min("rep").alias("component"))
    out = base.select("doc_id", "n_shingles", "print").join(of_class.join(least, "label").select("print", "component"), "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = written(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")))
    discard(*made)
    return out


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the near-duplicates of a smaller doc_id; rows with a null doc_id stay."""
    out = near_duplicates(docs, **settings).where("not kept").select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti")
