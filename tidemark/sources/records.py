"""Readers with fixed schemas and named faults, and record sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines under a schema: a byte order mark and blank lines are skipped; a bad line fails, or keeps its text in ``_corrupt`` if not ``strict``."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line")).where("trim(line) <> ''")
    if strict:
        return lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    parsed = lines.select("line", F.from_json("line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; a row that does not fit the schema fails."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, or an empty table where the path does not exist on the input's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return read_json_lines(spark, path, schema) if there else spark.createDataFrame([], schema)


def followed(spark: SparkSession, records: DataFrame, locator: str, root: str, schema: str) -> DataFrame:
    """``records`` with a row for each JSON line of the file that ``locator`` (a path below ``root``) names; a file that is not there gives one row with nulls.

    Files are read once and met by name, so a manifest of any length stays distributed.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(root).select(F.col("_metadata.file_path").alias("_path"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_r"))
    prefix = root.rstrip("/").rpartition("://")[2].removeprefix("file:") + "/"
    below = lines.withColumn("_at", F.substring_index("_path", prefix, -1))
    return records.join(below, records[locator] == below["_at"], "left").select(*records.columns, "_r.*")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def last_by_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each key, the last by ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``; reading a key that is there twice fails."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    wrong = F.raise_error(F.concat(F.lit("key is there twice: "), F.to_json(F.struct(*keys))))
    return df.join(counts.where(F.when(F.col("_n") > 1, wrong.cast("boolean")).otherwise(True)).select(*keys), keys, "left_semi")


def parse_segments(responses: DataFrame, chunk: str, response: str, duration: str) -> DataFrame:
    """Model answers as JSON, fenced or plain, to rows of segments and a status for each answer.

    Status: 'ok', 'empty' (no highlight), 'truncated' (no closing brace), 'malformed', 'invalid' (a start outside the chunk, an end not after it, a score
    outside 0 to 1). Ends beyond the chunk are clipped to it. Columns added: status, segments.
    """
    body = F.regexp_replace(F.trim(response), r"^```(?:json)?\s*|\s*```$", "")
    schema = "struct<has_highlight:boolean,segments:array<struct<start_sec:double,end_sec:double,score:double,reason:string>>>"
    parsed = responses.withColumn("_body", body).withColumn("_r", F.from_json("_body", schema))
    good = lambda x: x["start_sec"].isNotNull() & x["end_sec"].isNotNull() & (x["start_sec"] >= 0) & (x["start_sec"] < F.col(duration)) & (x["end_sec"] > x["start_sec"]) & F.coalesce(x["score"].between(0, 1), F.lit(False))
    bad = F.exists("_r.segments", lambda x: ~F.coalesce(good(x), F.lit(False)))
    status = (
        F.when(F.col("_body").isNull() | (F.col("_body") == ""), "malformed").when(F.col("_r").isNull() | F.col("_r.has_highlight").isNull(), F.when(F.col("_body").startswith("{") & ~F.col("_body").endswith("}"), "truncated").otherwise("malformed"))
        .when(~F.col("_r.has_highlight") | (F.size(F.coalesce("_r.segments", F.array())) == 0), "empty").when(bad, "invalid").otherwise("ok")
    )
    clipped = F.transform("_r.segments", lambda x: F.struct((F.col(chunk) + x["start_sec"]).alias("start_sec"), (F.col(chunk) + F.least(x["end_sec"], F.col(duration))).alias("end_sec"), x["score"].alias("score"), x["reason"].alias("reason")))
    out = parsed.withColumn("status", status).withColumn("segments", F.when(F.col("status") == "ok", clipped))
    return out.drop("_body", "_r")


def submission(rows: DataFrame, key: str, frame: str, box: list[str], ratio: tuple[int, int]) -> DataFrame:
    """One record for each key: its ratio and its boxes in frame order."""
    item = F.struct(F.col(frame).alias("frame"), F.array(*[F.col(c).cast("bigint") for c in box]).alias("bboxes"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("predictions")).select(F.col(key).alias("video_id"), F.array(*[F.lit(r) for r in ratio]).alias("targetRatioWH"), "predictions")


def issues(rows: DataFrame, key: str, frame: str, frames: str, width: str, height: str, ratio: tuple[int, int]) -> DataFrame:
    """Issue codes of boxes (x, y, w) whose height follows from the ratio; rows (key, frame, issues) of those with any."""
    from pyspark.sql import Window

    h = F.col("w") * ratio[1] / ratio[0]
    again = F.count(F.lit(1)).over(Window.partitionBy(key, frame)) > 1
    found = F.array_compact(
        F.array(
            F.when(F.col(frame).isNull() | (F.col(frame) < 0), "FRAME_NEGATIVE"), F.when(F.col(frame) >= F.col(frames), "FRAME_BEYOND_END"), F.when(again, "FRAME_DUPLICATE"), F.when(F.coalesce(F.col("w") <= 0, F.lit(True)), "WIDTH_NOT_POSITIVE"),
            F.when((F.col("x") < 0) | (F.col("y") < 0), "ORIGIN_NEGATIVE"), F.when(F.col("x") + F.col("w") > F.col(width), "BEYOND_RIGHT"), F.when(F.col("y") + h > F.col(height) + 1e-9, "BEYOND_BOTTOM"),
        )
    )
    return rows.select(key, frame, found.alias("issues")).where(F.size("issues") > 0)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A JSON object a line, null fields kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def merge_manifest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with their key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def not_done(all_rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return all_rows.join(done.select(*keys).distinct(), keys, "left_anti")
