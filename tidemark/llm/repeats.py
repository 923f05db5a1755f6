"""Removal of word passages that occur more than once in a corpus, by level-wise doubling.

A passage is a window of ``window`` words (35). Whole windows are not compared at first: at the
level of a quarter of the length every window is represented by its least sub-window of nine
words, which equal windows share. Windows whose sub-window occurs elsewhere too are extended to
the doubled length (18), and those that survive to the full length, where a window stands for
itself. Each level reads only the windows that the one before left. Equal windows have equal hashes, so
nothing repeated is lost; at the last level windows count as equal by 128 bits of hash, so that windows that differ
are taken for equal with a chance of some 1e-12 even among 1e13 windows.

A hash that a large share of all windows has (a passage in very many texts) is met by broadcast and spread over all
tasks: such hashes are at most ``HEAVY`` in number, as each has at least a part in ``HEAVY`` of the windows.

Equal texts are one row with a count first: they are covered whole, if they reach a window. The
texts lie compressed in a table bucketed by their digest, so levels move hashes and positions only.

Results for odd input: null and blank texts have no words and nothing removed; rows that repeat
a document count as further occurrences; null ids are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, scratch_dir, tidy_shuffles, written
from .words import mix, window_hashes, word_hashes

#: Hashes with at least this part of all rows of a level are heavy, so there are at most so many of them.
HEAVY = 50_000
#: Rows that a hash which is not heavy may have in any case.
LIGHT_ROWS = 2_000
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lengths(window: int) -> list[int]:
    """Lengths of the levels: a quarter of the window, a half, the whole."""
    return sorted({-(-window // 4), -(-window // 2), window})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        zip_ = zstandard.ZstdCompressor(level=3)
        packed = [zip_.compress((t.as_py() or "").encode()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(packed, pa.binary())], ["key", "packed"])


def _starts(words: int, window: int, ranges: np.ndarray | None) -> np.ndarray:
    """Starts of the windows that are still candidates; a range holds its first start and its length less one, in six bits."""
    if ranges is None:
        return np.arange(max(0, words - window + 1))
    lo, more = ranges >> 6, ranges & 63
    mark = np.zeros(words + 2, np.int32)
    np.add.at(mark, lo, 1)
    np.add.at(mark, lo + more + 1, -1)
    return np.flatnonzero(np.cumsum(mark) > 0)


def _anchors(window: int, length: int):
    """Rows (key, packed[, ranges]) to (hash, more, key, at): a row for each run of candidate windows with one least sub-window.

    ``more`` is a second hash at the full length, else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            open_ = zstandard.ZstdDecompressor()
            hashes, mores, keys, ats = [], [], [], []
            limited = "ranges" in batch.schema.names
            for i, (key, packed) in enumerate(zip(batch.column("key"), batch.column("packed"), strict=True)):
                words = word_hashes(open_.decompress(packed.as_py()))
                if len(words) < window:
                    continue
                start = _starts(len(words), window, np.asarray(batch.column("ranges")[i].values, np.int64) if limited else None)
                sub = window_hashes(words, length)
                least = start
                if (choice := window - length + 1) > 1:
                    views = np.lib.stride_tricks.sliding_window_view(sub, choice)
                    least = start + np.concatenate([views[start[k : k + 65536]].argmin(axis=1) for k in range(0, len(start), 65536)])
                new = np.flatnonzero(np.concatenate(([True], (np.diff(least) != 0) | (np.diff(start) != 1))))
                last = np.concatenate((new[1:], [len(start)])) - 1
                hashes.append(sub[least[new]].view(np.int64))
                mores.append(window_hashes(mix(words ^ _OTHER), length)[least[new]].view(np.int64) if length == window else np.zeros(len(new), np.int64))
                ats.append((start[new] << 6) | (start[last] - start[new]))
                keys.append((key.as_py(), len(new)))
            if hashes:
                which = np.repeat(np.arange(len(keys)), [n for _, n in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(mores)), pa.array([k for k, _ in keys], pa.binary()).take(pa.array(which)), pa.array(np.concatenate(ats))], ["hash", "more", "key", "at"])

    return run


def _cut(window: int):
    """Rows (key, packed, copies, ranges) to what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            open_ = zstandard.ZstdDecompressor()
            rows = []
            for key, packed, copies, ranges in zip(*(batch.column(c) for c in ("key", "packed", "copies", "ranges")), strict=True):
                text = open_.decompress(packed.as_py()).decode()
                words = _WORDS.findall(text)
                gone = np.zeros(len(words), bool)
                if copies.as_py() > 1 and len(words) >= window:
                    gone[:] = True
                elif ranges.is_valid:
                    mark = np.zeros(len(words) + 1, np.int32)
                    start = _starts(len(words), window, np.asarray(ranges.values, np.int64))
                    np.add.at(mark, start, 1)
                    np.add.at(mark, start + window, -1)
                    gone = np.cumsum(mark)[:-1] > 0
                kept = " ".join(words if not gone.any() else [w for w, g in zip(words, gone, strict=True) if not g])
                rows.append((key.as_py(), len(words), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest(), kept if gone.any() else text))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())], ["key", "n_words", "n_removed", "kept_sha256", "left"])

    return run


def _met(rows: DataFrame, again: DataFrame) -> DataFrame:
    """The ``rows`` (hash, more, key, at) whose hashes are in ``again`` (hash, more, n); rows of heavy hashes stay where they are."""
    total = again.agg(F.sum("n")).first()[0] or 0
    least = max(LIGHT_ROWS, -(-total // HEAVY))
    heavy = again.where(F.col("n") >= least).select("hash", "more", F.lit(True).alias("heavy"))
    marked = rows.join(F.broadcast(heavy), ["hash", "more"], "left")
    dealt = F.when(F.col("heavy"), F.xxhash64("key", "at")).otherwise(F.col("hash"))
    light = again.where(F.col("n") < least).select(F.col("hash").alias("dealt"), "more", F.lit(True).alias("light"))
    return marked.withColumn("dealt", dealt).join(light, ["dealt", "more"], "left").where("heavy or light").select("key", "at")


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 (of the kept words joined by spaces), and text without its repeated windows.

    A text that loses nothing stays as it is. All other columns of ``docs`` are carried through.
    """
    if not 4 <= window <= 84:
        raise ValueError("window must be 4 to 84 words")
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in ("text", "n_words", "n_removed", "kept_sha256")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], text.alias("text"), F.unhex(F.md5(text)).alias("key"))
    packed = keyed.select("key", "text").mapInArrow(_packed, "key binary, packed binary")
    unique = packed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("packed").alias("packed"))
    name = f"tidemark_{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        unique.write.option("path", f"{scratch_dir(spark)}/{name}").bucketBy(partitions(spark), "key").saveAsTable(name)
    texts = spark.table(name)

    ranges = None
    for length in lengths(window):
        source = texts.select("key", "packed") if ranges is None else texts.select("key", "packed").join(ranges, "key")
        rows = source.mapInArrow(_anchors(window, length), "hash long, more long, key binary, at long")
        again = written(rows.groupBy("hash", "more").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        before, ranges = ranges, written(_met(rows, again).groupBy("key").agg(F.collect_list("at").alias("ranges")))
        discard(again, *([before] if before is not None else []))
        if ranges.isEmpty():
            break
    cut = texts.join(ranges, "key", "left").select("key", "packed", "copies", "ranges").mapInArrow(_cut(window), "key binary, n_words long, n_removed long, kept_sha256 string, left string")
    out = keyed.drop("text").join(cut, "key")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], "n_words", "n_removed", "kept_sha256", F.col("left").alias("text"))
