"""Manifests against their rules and their files, and the candidates of a split from the tables that describe them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def manifest_issues(records: DataFrame, key: str, stratum: str | None = None, quotas: dict[str, int] | None = None, excluded: DataFrame | None = None, allowed: Column | None = None) -> DataFrame:
    """Issues (name, code, n) of a manifest: a key's `NULL_KEY`, `DUPLICATE`, `EXCLUDED` (in ``excluded``) or `NOT_ALLOWED` (``allowed`` does not hold), and a stratum's `QUOTA`, with its rows.

    ``quotas`` say how many rows each stratum has; one that they do not name has none. Null strata count as `null`.
    """
    again = F.count(F.lit(1)).over(Window.partitionBy(key)) if key in records.columns else F.lit(1)
    marked = records.withColumn("_again", again).withColumn("_out", F.lit(False))
    if excluded is not None:
        marked = marked.drop("_out").join(excluded.select(F.col(key).alias("_key")).distinct().withColumn("_out", F.lit(True)), F.col(key) == F.col("_key"), "left")
    tests = [(F.col(key).isNull(), "NULL_KEY"), (F.col(key).isNotNull() & (F.col("_again") > 1), "DUPLICATE"), (F.coalesce("_out", F.lit(False)), "EXCLUDED")]
    if allowed is not None:
        tests.append((~F.coalesce(allowed, F.lit(False)), "NOT_ALLOWED"))
    codes = F.array_compact(F.array(*[F.when(t, c) for t, c in tests]))
    out = marked.select(F.col(key).cast("string").alias("name"), F.explode(codes).alias("code")).groupBy("name", "code").agg(F.count(F.lit(1)).alias("n"))
    if quotas is not None:
        spark = records.sparkSession
        wanted = spark.createDataFrame(list(quotas.items()), "name string, _wanted long")
        have = records.groupBy(F.coalesce(F.col(stratum).cast("string"), F.lit("null")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
        wrong = have.join(wanted, "name", "full").where(F.coalesce("n", F.lit(0)) != F.coalesce("_wanted", F.lit(0)))
        out = out.unionByName(wrong.select("name", F.lit("QUOTA").alias("code"), F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    return out


def file_issues(spark: SparkSession, records: DataFrame, key: str, path: str, size: str, root: str, sha256: str | None = None) -> DataFrame:
    """Issues (key, code) of the files that a manifest names below ``root``: `NO_FILE`, `SIZE`, or `CONTENT` where ``sha256`` names a column of digests.

    Files are listed and met by name; their content is read only where digests are asked for.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/").rpartition("://")[2].removeprefix("file:") + "/"
    found = found.select(F.substring_index("path", prefix, -1).alias("_at"), F.col("length").alias("_length"), *([F.sha2("content", 256).alias("_digest")] if sha256 else []))
    both = records.join(found, F.col(path) == F.col("_at"), "left")
    code = F.when(F.col("_length").isNull(), "NO_FILE").when(~F.col(size).eqNullSafe(F.col("_length")), "SIZE")
    if sha256:
        code = code.when(~F.lower(sha256).eqNullSafe(F.col("_digest")), "CONTENT")
    return both.select(key, code.alias("code")).where("code is not null")


def require_manifest(records: DataFrame, issues: DataFrame, expected: int | None = None) -> DataFrame:
    """``records``; fails at once on the first issue, or if their number is not ``expected``."""
    first = issues.orderBy(*issues.columns).limit(1).collect()
    if first:
        raise ValueError(f"manifest: {first[0].asDict()}")
    if expected is not None and (n := records.count()) != expected:
        raise ValueError(f"manifest has {n} records instead of {expected}")
    return records


def split_candidates(alignment: DataFrame, raw: DataFrame, availability: DataFrame, split: str = "train") -> DataFrame:
    """Videos of an official split whose alignment passed, with their file: (canonical_video_id, realized_video_id, original_video_id, replacement_video_id, category, relative_path, sha256).

    ``alignment`` (canonical_video_id, official_split, passed, actual_source_id, category), ``raw`` (canonical_video_id, download_status, sha256, relative_path) and
    ``availability`` (canonical_video_id, original_video_id, replacement_video_id), which need not have a video. Fails, when the result is read, on a candidate
    without an id, a category, a row in ``raw``, a finished download, a digest or a path, and on a video that a table has twice.
    """
    key = "canonical_video_id"
    one = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(f"_{name}"), F.first(F.struct(*[c for c in df.columns if c != key])).alias(name))
    rows = alignment.where((F.lower(F.trim("official_split")) == split) & F.col("passed")).join(one(raw, "raw"), key, "left").join(one(availability, "seen"), key, "left")
    blank = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
    faults = [
        (blank(F.col(key)), "no canonical_video_id"), (F.col("_raw").isNull(), "no raw row"), ((F.col("_raw") > 1) | (F.coalesce("_seen", F.lit(0)) > 1), "two rows of a table"), (~F.coalesce(F.upper(F.trim("raw.download_status")) == "OK", F.lit(False)), "download is not OK"),
        (~F.coalesce(F.length("raw.sha256") == 64, F.lit(False)), "no digest"), (blank(F.col("raw.relative_path")), "no path"), (blank(F.col("category")), "no category"),
    ]
    fault = F.coalesce(*[F.when(t, m) for t, m in faults])
    stop = F.raise_error(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(": "), fault)).cast("boolean")
    sound = rows.where(F.when(fault.isNotNull(), stop).otherwise(True))
    real = lambda c: F.nullif(F.col(c), F.lit(""))
    return sound.select(key, F.coalesce(real("actual_source_id"), F.col(key)).alias("realized_video_id"), F.coalesce(real("seen.original_video_id"), F.col(key)).alias("original_video_id"), real("seen.replacement_video_id").alias("replacement_video_id"), "category", "raw.relative_path", "raw.sha256")
