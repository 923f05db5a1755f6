"""Bounded labelled samples and their chosen features, for the classifiers that numpy trains."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features of a whole text: distinct strings.
Features = Callable[[str], set[str]]


def first_by_hash(ids: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` ids of least hash: a bounded sample that does not depend on partitions."""
    return ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled(labels: DataFrame, column: str, learn) -> DataFrame:
    """(doc_id, y) of the rows that may be learnt from; of several labels of one document the largest counts."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & learn)
    return rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))


def _counts(features: Features, flush: int = 500_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(have[0].keys() | have[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in have)]
            for c in have:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["feature", "n0", "n1"])

        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y"), strict=True):
                have[y.as_py()].update(features(text.as_py() or ""))
                if len(have[0]) + len(have[1]) > flush:
                    yield out()
        yield out()

    return run


def choose(sample: DataFrame, features: Features, least: int, most: int, clear: float = 0.0) -> list[str]:
    """Up to ``most`` features that at least ``least`` sample rows have, the clearest first.

    Clearness is the log ratio of a feature's shares under the two labels over its standard error; ``clear`` is the least.
    """
    n1, n = sample.agg(F.sum("y"), F.count(F.lit(1))).first()
    if not n or not n1 or n == n1:
        return []
    counts = sample.select("text", "y").mapInArrow(_counts(features), "feature string, n0 long, n1 long")
    counts = counts.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= least)
    ratio = F.log((F.col("n1") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(n - n1 + 1.0))
    counts = counts.withColumn("tells", F.abs(ratio) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))).where(F.col("tells") >= clear)
    return [r.feature for r in counts.orderBy(F.col("tells").desc(), "feature").limit(most).select("feature").collect()]


def _rows(features: Features, index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(index[x] for x in features(t.as_py() or "") if x in index) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "y", "found"])

    return run


def matrix(sample: DataFrame, features: Features, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of present features end to end, first position of each row and the end, labels) of the bounded sample, in doc_id order."""
    rows = sample.select("doc_id", "text", F.col("y").cast("int").alias("y")).mapInArrow(_rows(features, index), "doc_id long, y int, found array<int>").toArrow().sort_by("doc_id")
    found = rows.column("found").combine_chunks()
    sizes = np.array([len(x) for x in found], np.int64)
    flat = np.concatenate([np.asarray(x.values, np.int64) for x in found if len(x)]) if sizes.sum() else np.zeros(0, np.int64)
    return flat, np.concatenate(([0], np.cumsum(sizes))), rows.column("y").to_numpy()


def margins(weights: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(weights[flat])))
    return sums[at[1:]] - sums[at[:-1]]


def scored(docs: DataFrame, features: Features, weights: dict[str, float], bias: float, slope: float = 1.0, shift: float = 0.0) -> DataFrame:
    """``docs`` columns doc_id and whole text to (doc_id, score): the logistic of slope * margin + shift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = weights.get
        for batch in batches:
            margin = np.array([bias + sum([get(x, 0.0) for x in features(t.as_py() or "")]) for t in batch.column("text")], float)
            score = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
