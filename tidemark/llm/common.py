"""Shared parts of the training-data operators: reading, folds, scratch tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while its measured size stays below this many bytes.
BROADCAST_BYTES = 32 << 20
#: Edges that a task of a round of components holds at once.
EDGES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids are in fold 1 of 5 and fold 0 of 3, so they may be learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(1 if modulus == 5 else 0))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. A temporary one only where it is unset and Spark is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of writes inside go when the write ends: the table that it leaves needs them no more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df``, one row for each ``key``, in the shared folder, bucketed by it: later joins on it move only the other side."""
    spark = df.sparkSession
    name = f"tidemark_{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        df.repartition(buckets, key).dropDuplicates([key]).write.option("path", f"{scratch_dir(spark)}/{name}").bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made; nothing that is still to run may read them."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/tidemark-" in path:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each component of the graph with edges (a, b) over 0 to n - 1: the higher root hangs on the lower, then paths are halved."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) to stars (member, least member) of the components that each EDGES of them make."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        ends = np.concatenate([b.column(c).to_numpy() for c in ("u", "v") for b in held])
        names, at = np.unique(ends, return_inverse=True)
        half = len(at) // 2
        root = roots(at[:half], at[half:], len(names))
        own = root == np.arange(len(root))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(names[~own]), pa.array(names[root[~own]])], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= EDGES:
            yield flush()
    if held:
        yield flush()


def _mark(edges: DataFrame) -> tuple:
    """Count and two order-free sums: equal for equal edge sets."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1000003)))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), the component being its smallest node.

    Each round turns every EDGES edges of a part into stars in one task, then takes a large-star and a
    small-star step, which turn chains into stars in a logarithmic number of rounds and keep the number
    of edges at most. Where all edges are one part, its stars are the components. A table in the shared
    folder is written per round, so that the lineage stays short. Only changed-edge counts reach the driver.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        parts = 1 + mark[0] // EDGES
        stars = now.repartition(parts, "v").mapInArrow(_stars, "u long, v long")
        if parts == 1:
            after = written(stars)
            discard(now)
            now = after
            break
        stars = stars.distinct()
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every neighbour above u now hangs on u's least neighbour
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: u and all its neighbours below it hang on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        discard(now)
        now, was, mark = after, mark, _mark(after)
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
