"""A shard store that only shows whole shards: staged data, then a status with count and content mark, each published by one rename.

Folders below the root: `identity.json` (what run the store belongs to), `data/attempt=<a>` and `status/attempt=<a>` (one of each
for an attempt that ended), `staging` (what a killed attempt left). A shard counts only with a status; of two attempts at the same shard the
first by name counts. So a task or a driver that dies, or runs twice, at any place leaves rows that nobody reads, and a resumed run
writes only the shards that have no status.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of a partitioned table at most, and the column of those by hash.
FOLDERS, FOLDER = 256, "key_folder"


class IdentityError(ValueError):
    """The store belongs to a run with another identity."""


class ContentError(ValueError):
    """Published data is not what its status says."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    return folder.rstrip("/")


class _Files:
    """The few calls on a file system that the store needs, on whatever file system its root is."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._fs = self._at(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def names(self, path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(path))) if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._at(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a file beside the place and moves it there; False if something is there already."""
        beside = f"{path}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(beside), False)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        return self.move(beside, path)

    def move(self, source: str, target: str) -> bool:
        self._fs.mkdirs(self._at(target.rpartition("/")[0]))
        if self.exists(target) or not self._fs.rename(self._at(source), self._at(target)):
            self.delete(source)
            return False
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._at(path), True)


def content_mark(columns: list[str]) -> dict[str, Column]:
    """Rows of a group and two order-free marks of their content, which add up before the shuffle."""
    h, g = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    return {"rows": F.count(F.lit(1)), "mark": F.bit_xor(h), "total": F.sum(F.pmod(g, F.lit(1 << 40)))}


class ShardStore:
    """Shards of rows with equal ``key`` below ``root``, for runs with one ``identity``."""

    def __init__(self, spark: SparkSession, root: str, key: str, identity: dict):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.identity = json.dumps(identity, sort_keys=True)
        self.files = _Files(spark, root)

    def bind(self, resume: bool = True) -> None:
        """Makes the store this run's, or checks that it is: it fails if another run's is there, or any where ``resume`` is not wanted."""
        place = f"{self.root}/identity.json"
        if not self.files.exists(place) and self.files.create(place, self.identity):
            return
        if self.files.read(place) != self.identity:
            raise IdentityError(f"{self.root} belongs to a run with another identity")
        if not resume:
            raise IdentityError(f"{self.root} is there, and this run does not resume it")

    def attempts(self) -> list[str]:
        """Attempts with a published status: one for each time a run got to its end."""
        data = set(self.files.names(f"{self.root}/data"))
        return [a for a in self.files.names(f"{self.root}/status") if a.startswith("attempt=") and a in data]

    def _table(self, kind: str) -> DataFrame | None:
        found = self.attempts()
        return self.spark.read.option("basePath", f"{self.root}/{kind}").parquet(*[f"{self.root}/{kind}/{a}" for a in found]) if found else None

    def status(self) -> DataFrame | None:
        """A row for each whole shard: key, attempt, rows, mark, total."""
        found = self._table("status")
        if found is None:
            return None
        rest = [c for c in found.columns if c not in (self.key, "attempt")]
        return found.groupBy(self.key).agg(F.min_by(F.struct("attempt", *rest), "attempt").alias("s")).select(self.key, "s.*")

    def read(self) -> DataFrame:
        """The rows of whole shards."""
        data, status = self._table("data"), self.status()
        if data is None:
            raise ContentError(f"{self.root} has no whole shard")
        same = [data[c].eqNullSafe(F.col(f"s.{c}")) for c in (self.key, "attempt")]
        return data.join(status.select(self.key, "attempt").alias("s"), same[0] & same[1], "left_semi").drop("attempt")

    def _marks(self, rows: DataFrame, by: list[str]) -> DataFrame:
        columns = sorted(c for c in rows.columns if c != "attempt")
        return rows.groupBy(*by).agg(*[c.alias(n) for n, c in content_mark(columns).items()])

    def verify(self) -> DataFrame:
        """(key, state) of each shard with a status: COMPLETE, MISSING without any of its rows, or DIFFERS."""
        status, data = self.status(), self._table("data")
        if status is None:
            raise ContentError(f"{self.root} has no whole shard")
        found = self._marks(data, [self.key, "attempt"]).select(*[F.col(c).alias(f"_{c}") for c in (self.key, "attempt", "rows", "mark", "total")])
        both = status.join(found, status[self.key].eqNullSafe(F.col(f"_{self.key}")) & (F.col("attempt") == F.col("_attempt")), "left")
        same = (F.col("rows") == F.col("_rows")) & (F.col("mark") == F.col("_mark")) & (F.col("total") == F.col("_total"))
        return both.select(self.key, F.when(F.col("_rows").isNull(), "MISSING").when(same, "COMPLETE").otherwise("DIFFERS").alias("state"))

    def pending(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose shard has no status. Fails if a shard with one is not what it says."""
        status = self.status()
        if status is None:
            return df
        wrong = self.verify().where("state <> 'COMPLETE'").limit(1).collect()
        if wrong:
            raise ContentError(f"shard {wrong[0][self.key]} of {self.root}: {wrong[0].state}")
        done = status.select(F.col(self.key).alias("_done"))
        return df.join(done, df[self.key].eqNullSafe(F.col("_done")), "left_anti")

    def stage(self, df: DataFrame, attempt: str) -> None:
        """Writes the rows of an attempt where nobody reads them; a shard's rows may be spread over files."""
        df.write.parquet(f"{self.root}/staging/data-{attempt}")

    def publish(self, attempt: str) -> None:
        """Data first, then the status that makes it count; marks come from the staged files, not from what they were made of."""
        staged = self.spark.read.parquet(f"{self.root}/staging/data-{attempt}")
        self._marks(staged, [self.key]).write.parquet(f"{self.root}/staging/status-{attempt}")
        for kind in ("data", "status"):
            if not self.files.move(f"{self.root}/staging/{kind}-{attempt}", f"{self.root}/{kind}/attempt={attempt}"):
                raise ContentError(f"attempt {attempt} is there already")

    def write(self, df: DataFrame, resume: bool = True) -> str:
        """Adds the shards of ``df`` that are not there yet. Each is whole or absent to readers, whenever the run dies."""
        self.bind(resume)
        attempt = uuid.uuid4().hex
        self.stage(self.pending(df), attempt)
        self.publish(attempt)
        return attempt

    def sweep(self) -> list[str]:
        """Deletes what killed attempts left, while no run writes; returns the names."""
        kept = set(self.attempts())
        gone = [f"staging/{n}" for n in self.files.names(f"{self.root}/staging")] + [f"{kind}/{n}" for kind in ("data", "status") for n in self.files.names(f"{self.root}/{kind}") if n not in kept]
        for name in gone:
            self.files.delete(f"{self.root}/{name}")
        return gone


def _folder(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int")


def write_partitioned(df: DataFrame, path: str, key: str) -> None:
    """A Parquet table with a folder for each ``key``; beyond FOLDERS keys, with so many folders by the key's hash, so that files do not grow with the keys. Rows of a folder go to few files, a hot key to several by salt."""
    by = key
    if df.select(key).distinct().limit(FOLDERS + 1).count() > FOLDERS:
        by, df = FOLDER, df.withColumn(FOLDER, _folder(key))
    df.withColumn("_salt", F.floor(F.rand(11) * 4)).repartition(by, "_salt").drop("_salt").write.partitionBy(by).parquet(path)


def read_subset(spark: SparkSession, path: str, wanted: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Rows of a table of ``write_partitioned`` whose key is in ``wanted``: only the folders of wanted keys are read (dynamic partition pruning).

    With ``strict``, a wanted key without a row fails when the result is read.
    """
    rows, keys = spark.read.parquet(path), wanted.select(key).distinct()
    if strict:
        have = rows.select(key).distinct().withColumn("_have", F.lit(True))
        gap = F.raise_error(F.concat(F.lit(f"no rows of {key} "), F.col(key).cast("string"))).cast("boolean")
        keys = keys.join(have, key, "left").where(F.when(F.col("_have").isNull(), gap).otherwise(True)).select(key)
    if FOLDER not in rows.columns:
        return rows.join(keys, key)
    keys = keys.withColumn(key, F.col(key).cast(rows.schema[key].dataType)).withColumn(FOLDER, _folder(key))  # the hash depends on the type
    return rows.join(keys, [key, FOLDER]).drop(FOLDER)


def sample_lookup(samples: DataFrame, tables: dict[str, DataFrame], key: str, split: str, checks: dict[str, Column]) -> DataFrame:
    """``samples`` of one split joined with a row of each table by ``key``. Fails on a sample without a row somewhere, with two, or one that a check calls wrong.

    ``checks`` name conditions over the joined columns that must hold; columns of a table are a struct named like it.
    """
    out = samples
    for name, table in tables.items():
        one = table.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[c for c in table.columns if c != key])).alias(name))
        out = out.join(one, key, "left")
        fault = F.raise_error(F.concat(F.when(F.col("_n").isNull(), F.lit("no row in ")).otherwise(F.lit("two rows in ")), F.lit(f"{name} for "), F.col(key).cast("string")))
        out = out.where(F.when(F.coalesce(F.col("_n") != 1, F.lit(True)), fault.cast("boolean")).otherwise(True)).drop("_n")
    checks = {"split": F.col("split") == split} | checks
    for name, holds in checks.items():
        fault = F.raise_error(F.concat(F.lit(f"{name} does not hold for "), F.col(key).cast("string"))).cast("boolean")
        out = out.where(F.when(F.coalesce(holds, F.lit(False)), True).otherwise(fault))
    return out
