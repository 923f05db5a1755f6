"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

The test items are the indexed side; every passage of the corpus is a query. Passages are windows of
twice the longest item's words, half overlapping, so that an item that stands in a text stands whole in a
passage. An item's BM25 score is taken as a share of the score that it gets for its own text, and all items
of at least ``threshold`` are retrieved. Items are laid in blocks; a term's postings are sparse, with the term's largest
impact over all items and in each block that has it. The terms of a passage stand in the order of their largest
impacts, and the pivot is the first at which these add up to a quarter of the threshold: the terms below it name no candidates. The block
maxima of the others are summed, and only blocks that can still reach the threshold with the terms below the pivot get their
block maxima, and of those only blocks whose bounds reach it get scores. Many passages go through each step at once. What is retrieved is
verified: the word trigrams of the question (all sentences but the last) and of the answer (the last
sentence; the last third where there is one sentence) must overlap with the passage's, each in a share of ``overlap``.

Term counts are a grouping; an index of ``shard`` items at most is built in one task from its postings, written to the shared folder and
broadcast, and each index takes one scan of the corpus. A scan holds ``ROWS`` bounds at a time, however long a text is.
Results for odd input: null or blank texts and items match nothing;
an item without words is never retrieved; repeated items and documents give a row for each distinct pair;
rows with a null doc_id are one document with that id. Empty tables give an empty result.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Bounds and block maxima that a scan holds at a time, a passage at least.
ROWS = 1 << 18
#: Words of texts that a scan takes at a time, and those of one longer text.
WORDS = 1 << 15
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_answer(text: str | None) -> tuple[list[str], list[str]]:
    parts = [w for w in map(words_of, _SENTENCE.split(text or "")) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - -(-len(words) // 3)
    return words[:cut], words[cut:]


def trigrams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, one after another, and the range that each is of."""
    of = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(of)) + np.repeat(starts - np.cumsum(counts) + counts, counts), of


class Index:
    """Postings with impacts as shares of each item's own score, and their largest values by term and by block.

    ``df``: items by word; ``count``, ``mean``: items that have words, and their mean words.
    Terms are numbered by their largest impact. An entry is a term in a block.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], count: int, mean: float, block: int = 8, k1: float = 1.2, b: float = 0.75):
        rows = [(i, w, t) for i, t in items if (w := words_of(t))]
        rows.sort(key=lambda x: (min(x[1], key=lambda w: (-df[w], w)), x[0], x[2]))  # items of one language near one another
        self.ids = [i for i, _, _ in rows]
        self.parts = [tuple(map(trigrams, question_answer(t))) for _, _, t in rows]
        self.longest = max((len(w) for _, w, _ in rows), default=1)
        self.block, self.blocks = block, max(1, -(-len(rows) // block))
        names: dict[str, int] = {}
        posts: list[tuple[int, int, float]] = []
        for k, (_, words, _) in enumerate(rows):
            gain = {w: np.log(1 + (count - df[w] + 0.5) / (df[w] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * len(words) / mean)) for w, n in Counter(words).items()}
            own = sum(gain.values())
            posts += [(names.setdefault(w, len(names)), k, x / own) for w, x in gain.items()]
        term, self.item, self.impact = (np.array(x, kind) for x, kind in zip(zip(*posts, strict=True) if posts else [()] * 3, (np.int64, np.int64, np.float64), strict=True))
        most = np.zeros(len(names))
        np.maximum.at(most, term, self.impact)
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(most, kind="stable")] = np.arange(len(names))
        self.terms, self.most = {w: int(rank[at]) for w, at in names.items()}, np.sort(most)
        order = np.lexsort((self.item, rank[term]))
        term, self.item, self.impact = rank[term][order], self.item[order], self.impact[order]
        key = term * self.blocks + self.item // block
        #: Of each entry: its term and block as one number, its first posting, its largest impact. Of each term: its first entry.
        self.keys, self.first = np.unique(key, return_index=True)
        self.peak = np.maximum.reduceat(self.impact, self.first) if len(key) else np.zeros(0)
        self.first = np.append(self.first, len(key))
        self.start = np.searchsorted(self.keys, np.arange(len(names) + 1) * self.blocks)

    def _entries(self, terms: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the (term, block) pairs that have one, and the pairs' places."""
        key = terms * self.blocks + blocks
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        have = np.flatnonzero(self.keys[at] == key)
        return at[have], have

    def search(self, passages: np.ndarray, terms: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (passage, item, score) of at least ``threshold``, for distinct (passage, term) sorted by both."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        names, start = np.unique(passages, return_index=True)
        ends = np.append(start, len(passages))
        entries = np.add.reduceat(self.start[terms + 1] - self.start[terms], start) if len(start) else start
        load, k = np.cumsum(entries + self.blocks), 0
        while k < len(names):
            to = max(k + 1, int(np.searchsorted(load, (load[k - 1] if k else 0) + ROWS, side="right")))
            found = self._search(start[k:to] - start[k], terms[ends[k] : ends[to]], threshold)
            out.append((names[k + found[0]], *found[1:]))
            k = to
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _search(self, start: np.ndarray, terms: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, blocks = len(start), self.blocks
        size = np.diff(np.append(start, len(terms)))
        passage = np.repeat(np.arange(n), size)
        sums = np.concatenate(([0.0], np.cumsum(self.most[terms])))
        below = sums[1:] - sums[start][passage] < threshold / 4  # the terms below the pivot
        low = np.bincount(passage[below], minlength=n)
        rest = sums[start + low] - sums[start]
        drive = np.flatnonzero(~below)
        entry, of = _ranges(self.start[terms[drive]], self.start[terms[drive] + 1] - self.start[terms[drive]])
        bound = np.bincount(passage[drive[of]] * blocks + self.keys[entry] - terms[drive[of]] * blocks, self.peak[entry], n * blocks).reshape(n, blocks)
        p, b = np.nonzero(bound + rest[:, None] >= threshold - 1e-6)
        bound = bound[p, b]
        at, of = _ranges(start[p], low[p])
        entry, have = self._entries(terms[at], b[of])
        bound += np.bincount(of[have], self.peak[entry], len(p))
        reach = bound >= threshold - 1e-6
        p, b = p[reach], b[reach]
        at, of = _ranges(start[p], size[p])
        entry, have = self._entries(terms[at], b[of])
        post, which = _ranges(self.first[entry], self.first[entry + 1] - self.first[entry])
        score = np.bincount(of[have[which]] * self.block + self.item[post] % self.block, self.impact[post], len(p) * self.block)
        hit = np.flatnonzero(score >= threshold - 1e-9)
        return p[hit // self.block], b[hit // self.block] * self.block + hit % self.block, score[hit]


def _matches(index: Index, texts: list[tuple[int | None, list[str]]], threshold: float, overlap: float) -> Iterator[tuple]:
    """Rows (doc, item, score, question overlap, answer overlap) of the documents' passages."""
    get, half, size = index.terms.get, index.longest, len(index.terms)
    starts, parts, terms, at = [], [], [], 0  # of each document: its first part; a part that is empty follows its last
    for _, words in texts:
        ids = np.array([get(w, -1) for w in words], np.int64)
        known = np.flatnonzero(ids >= 0)
        starts.append(at)
        parts.append(at + known // half)
        terms.append(ids[known])
        at += -(-len(words) // half) + 1
    pairs = np.unique(np.concatenate(parts) * size + np.concatenate(terms))
    part, term = pairs // size, pairs % size
    inner = ~np.isin(part, starts)  # the first part of a document ends no passage
    passages = np.unique(np.concatenate([pairs, pairs[inner] - size]))  # passage k holds the parts k and k + 1
    for passage, item, score in zip(*(x.tolist() for x in index.search(passages // size, passages % size, threshold)), strict=True):
        k = int(np.searchsorted(starts, passage, side="right")) - 1
        doc, words = texts[k]
        here = words[(passage - starts[k]) * half : (passage - starts[k] + 2) * half]
        share = []
        for grams in index.parts[item]:
            n = len(next(iter(grams), ()))
            share.append(len(grams & {tuple(here[i : i + n]) for i in range(len(here) - n + 1)}) / len(grams) if grams else 1.0)
        if min(share) >= overlap:
            yield doc, index.ids[item], score, *share


def _scan(shipped, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = pickle.loads(shipped.value)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

        def out(texts: list[tuple[int | None, list[str]]]) -> pa.RecordBatch:
            columns = list(zip(*_matches(index, texts, threshold, overlap), strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        for batch in batches if index.terms else ():
            texts, held = [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                if not words:
                    continue
                if held and held + len(words) > WORDS:
                    yield out(texts)
                    texts, held = [], 0
                texts.append((doc, words))
                held += len(words)
            if texts:
                yield out(texts)

    return run


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pa.array([words_of(t.as_py()) for t in batch.column("text")], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*batch.columns, words], ["item_id", "text", "words"])


def _built(count: int, mean: float):
    """The items of a shard, with the counts of their words, to their pickled index."""

    def run(table: pa.Table) -> pa.Table:
        df = {w: n for row in table.column("df").to_pylist() for w, n in ((x["word"], x["n"]) for x in row)}
        index = Index(list(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True)), df, count, mean)
        return pa.table({"shard": table.column("shard").slice(0, 1), "index": pa.array([pickle.dumps(index, 5)], pa.binary())})

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5, shard: int = 20_000) -> DataFrame:
    """Rows (doc_id, item_id, n_passages, score, question_overlap, answer_overlap), one for each document and test item in it."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    listed = items.mapInArrow(_worded, "item_id long, text string, words array<string>").where(F.size("words") > 0)
    listed = written(listed.withColumn("row", F.monotonically_increasing_id()))
    count, total = listed.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    shards = -(-count // shard)
    worded = listed.select("row", F.explode(F.array_distinct("words")).alias("word"))
    counted = worded.join(worded.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word").groupBy("row").agg(F.collect_list(F.struct("word", "n")).alias("df"))
    rows = listed.join(counted, "row").select(F.pmod(F.xxhash64("row"), F.lit(max(1, shards))).cast("int").alias("shard"), "item_id", "text", "df")
    built = written(rows.groupBy("shard").applyInArrow(_built(count, max(1.0, (total or 0) / max(1, count))), "shard int, index binary"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = spark.createDataFrame([], schema)
    for k in range(shards):
        for row in built.where(F.col("shard") == k).collect():
            out = out.unionAll(docs.mapInArrow(_scan(spark.sparkContext.broadcast(bytes(row["index"])), threshold, overlap), schema))
    discard(listed, built)
    best = [F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")]
    return out.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_passages"), *best)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents that hold a test item; rows with null ids stay."""
    bad = leaks(docs, benchmark, **settings).where("doc_id is not null").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
