"""Ragged sequences as padded batches with masks, fixed feature rows, and hashed text vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_key
from .selection import numbered


def padded_batches(df: DataFrame, key: str, order: list[str], fields: dict[str, object], size: int, least: int = 8) -> DataFrame:
    """A row for each key: (bucket, batch, place, key, length, <fields>, mask, last), its sequences padded to the bucket's length.

    ``fields`` name columns and what pads them. Buckets are powers of two from ``least`` on; keys of a bucket are dealt in hash order into batches of ``size``.
    ``mask`` is true for what is not padding, ``last`` where the next element is padding too (false for transitions into it). A key's rows must fit a task.
    """
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in fields if c not in order]))).alias("_rows")).withColumn("length", F.size("_rows"))
    wide = F.greatest(F.lit(least), F.pow(F.lit(2), F.ceil(F.log2("length"))).cast("int"))
    rows = rows.withColumn("bucket", wide)
    kinds = dict(df.dtypes)
    column = lambda c: F.transform("_rows", lambda r: r[c])
    padded = [F.concat(column(c), F.array_repeat(F.lit(pad).cast(kinds[c]), F.col("bucket") - F.col("length"))).alias(c) for c, pad in fields.items()]
    mask = F.concat(F.array_repeat(F.lit(True), F.col("length")), F.array_repeat(F.lit(False), F.col("bucket") - F.col("length")))
    last = F.concat(F.array_repeat(F.lit(True), F.col("length") - 1), F.array_repeat(F.lit(False), F.col("bucket") - F.col("length") + 1))
    out = rows.select("bucket", key, "length", *padded, mask.alias("mask"), last.alias("last"), hash_key(F.lit("batch"), F.col(key)).alias("_h"))
    placed = numbered(out, ["bucket"], ["_h", key], F.substring("_h", 1, 3), "_place")
    return placed.select("bucket", F.floor((F.col("_place") - 1) / size).alias("batch"), ((F.col("_place") - 1) % size).alias("place"), key, "length", *fields, "mask", "last")


def feature_row(signals: dict[str, Column], names: list[str], switches: set[str]) -> Column:
    """A struct of `values`, one double for each of ``names``, and `missing`. A signal that is null or not finite is 0 and missing, one without a column is missing; ``switches`` are 1 above one half, else 0.

    Fails on a signal that is not among the names.
    """
    unknown = set(signals) - set(names)
    if unknown:
        raise ValueError(f"unknown signals {sorted(unknown)}")
    values, missing = [], []
    for name in names:
        x = signals[name].cast("double") if name in signals else F.lit(None).cast("double")
        gone = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        value = F.when(x > 0.5, 1.0).otherwise(0.0) if name in switches else x
        values.append(F.when(gone, 0.0).otherwise(value))
        missing.append(F.coalesce(gone, F.lit(True)))
    return F.struct(F.array(*values).alias("values"), F.array(*missing).alias("missing"))


def text_vector(text: str | None, places: int, low: int, high: int, chars: int | None, memo: dict[str, int]) -> np.ndarray:
    """Counts of the character n-grams of a text, by hash into ``places`` numbers, with unit length; zero for a blank text."""
    out = np.zeros(places)
    clean = " ".join((text or "").split())[:chars]
    for n in range(low, high + 1):
        for k in range(len(clean) - n + 1):
            gram = f"{n}:{clean[k : k + n]}"
            place = memo.get(gram)
            if place is None:
                if len(memo) > 1 << 20:
                    memo.clear()
                place = memo[gram] = int.from_bytes(hashlib.blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") % places
            out[place] += 1
    length = np.sqrt((out * out).sum())
    return (out / length if length else out).astype(np.float32)


def text_vectors(df: DataFrame, keys: list[str], text: str, places: int = 128, low: int = 2, high: int = 3, chars: int | None = 400) -> DataFrame:
    """Rows (keys, vector) with a hashed vector of each text's character n-grams; ``chars`` is how much of a text counts, by definition of the vector (None: all)."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            flat = [text_vector(t, places, low, high, chars, memo) for t in batch.column(text).to_pylist()]
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.float32))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * places), values)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], vectors], [*keys, "vector"])

    return df.select(*keys, text).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", vector array<float>")
