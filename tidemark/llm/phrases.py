"""Phrase collocations: frequent word sequences of each language that occur more often together than their parts would by chance.

Identical pieces of text become one row with their multiplicity. Tasks cut pieces into n-grams, which are dealt out
by hash; each bucket is counted in duckdb, which spills to the shared folder. Only phrases that reach the threshold leave a bucket: any part of a
candidate is as frequent as the candidate. Parts are looked up by requests that are shuffled to where their counts are.

Counting goes by length. A phrase can only be frequent if its words are, and so its pairs; two bit maps of fixed size, of
frequent words and of frequent pairs, tell tasks what need not be counted further. A bit that is shared by chance costs work, never a
result; the counts are exact whatever the bit maps hold.

Results for odd input: null texts are empty; a null lang is `und`; empty texts and pieces without words have no phrases; rows that
repeat count each time; equal scores go by frequency, then by phrase; a text of any length is counted whole; empty tables
give an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, partitions, scratch_dir, written
from .words import _BYTE, _power, bounds, mix, window_hashes, word_hashes

#: Bits of a map of frequent words or pairs (8 MB), bytes of text and n-grams that a task works on at once, memory of duckdb in a task.
BITS = 1 << 26
BYTES = 1 << 20
ROWS = 1 << 18
MEMORY = "256MB"
#: Copies of the count of a word that share its requests.
SALTS = 32
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def pieces(docs: DataFrame) -> DataFrame:
    """Distinct pieces (lang, piece, c) of all texts: words of a piece stand one space apart, c is how often it occurs."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text, r"[.,;:!?\x0A-\x0D]+")).alias("piece"))
    words = cut.select("lang", F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " ")).alias("piece")).where("piece <> ''")
    return words.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("c"))


def _parts(text: str, overlap: int, size: int = BYTES) -> Iterator[tuple[str, int]]:
    """Stretches of a long piece and how many of their last words only complete n-grams of the words before."""
    start = 0
    while len(text) - start > size:
        end = text.find(" ", start + size)
        if end < 0:
            break
        more = end
        for _ in range(overlap):
            more = text.find(" ", more + 1)
            if more < 0:
                break
        if more < 0:
            break
        yield text[start:more], overlap
        start = end + 1
    yield text[start:], 0


def _slices(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings between two byte places each."""
    size = end - start
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    at = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw[at]))


def _hashes(data: bytes, lang: np.ndarray) -> np.ndarray:
    """A hash of each word with its language."""
    return mix(word_hashes(data) ^ lang)


def _lang_hash(lang: str) -> np.uint64:
    found = window_hashes(word_hashes(lang.encode("utf-8", "surrogatepass")), 1)
    return found[0] if len(found) else np.uint64(0)


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _packed(counts: pa.Table, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, lang, n, body): the phrases and counts of a bucket in few bytes, instead of a row of the shuffle for each."""
    press = zstandard.ZstdCompressor(level=1)
    for lang in counts.column("lang").unique():
        own = counts.filter(pc.equal(counts.column("lang"), lang))
        phrases = own.column("phrase").combine_chunks()
        data, start, end = _joined(phrases)
        bucket = (slice_hashes(data, start, end) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        data, start, _ = _joined(phrases.take(pa.array(order)))
        f, bucket = own.column("f").to_numpy()[order].astype("<i8"), bucket[order]
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        last = np.append(first[1:], len(order))
        ends = np.append(start[first[1:]] - 1, len(data))
        bodies = [press.compress(f[i:j].tobytes() + data[a:b]) for i, j, a, b in zip(first, last, start[first], ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([lang.as_py()] * len(first)), pa.array((last - first).astype(np.int32)), pa.array(bodies, pa.binary())], ["bucket", "lang", "n", "body"])


def slice_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash for the bytes between two places each."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = _power(_BYTE, len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)], dtype=np.uint64)))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _joined(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts with a line break between them, and the first byte and the end of each."""
    data = pc.binary_join_element_wise(texts, "", "\n").buffers()[2].to_pybytes()[:-1] if len(texts) else b""
    end = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1) - 1
    return data, np.concatenate((np.zeros(1, np.int64), end[:-1] + 1)), end


def _unpacked(batch: pa.RecordBatch) -> pa.Table:
    """Rows (lang, phrases, fs): the phrases of a body with line breaks between them, and their counts."""
    n, bodies = batch.column("n").to_numpy(), [zstandard.decompress(x.as_py()) for x in batch.column("body")]
    counts = np.frombuffer(b"".join([x[: 8 * k] for x, k in zip(bodies, n, strict=True)]), "<i8")
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(counts))
    phrases = pa.array([x[8 * k :] for x, k in zip(bodies, n, strict=True)], pa.binary()).cast(pa.string())
    return pa.table([batch.column("lang"), phrases, lists], ["lang", "phrases", "fs"])


def _grams(low: int, high: int, buckets: int, words, pairs):
    """Rows (lang, piece, c) to n-grams of ``low`` to ``high`` words, added up within a task as far as it holds them, packed for their buckets; maps of words or pairs say which can be frequent."""

    def cut(texts: pa.Array, tails: np.ndarray, langs: pa.Array, weight: np.ndarray) -> Iterator[pa.Table]:
        data = _joined(texts)[0]
        raw = np.frombuffer(data, np.uint8)
        start, end = bounds(data)
        sizes = pc.count_substring(texts, " ").to_numpy(zero_copy_only=False) + 1
        piece, place = np.repeat(np.arange(len(texts)), sizes), np.arange(len(start))
        last = np.cumsum(sizes)[piece]  # the first word after the piece
        begins = place < last - tails[piece]
        coded = langs.dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if words is not None:
            hashes = _hashes(data, np.array([_lang_hash(n) for n in names], np.uint64)[codes[piece]])
            good = np.concatenate((_held(words.value, hashes), [False]))
            if pairs is not None:
                both = window_hashes(hashes, 2)
                paired = np.concatenate((_held(pairs.value, both), [False]))[: len(place)] & (place + 1 < last)
        for n in range(low, high + 1):
            keep = begins & (place + n <= last)
            if pairs is not None:
                for k in range(n - 1):
                    keep &= np.concatenate((paired[k : len(place)], np.zeros(k, bool)))
            elif words is not None:
                for k in range(n):
                    keep &= np.concatenate((good[k : len(place)], np.zeros(k, bool)))
            found = np.flatnonzero(keep)
            for k in range(0, len(found), ROWS):
                at = found[k : k + ROWS]
                lang = pa.DictionaryArray.from_arrays(pa.array(codes[piece[at]].astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
                yield pa.table([lang, _slices(raw, start[at], end[at + n - 1]), pa.array(weight[piece[at]])], schema=_COUNTS)

    def merged(tables: list[pa.Table]) -> pa.Table:
        both = pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
        return both.rename_columns(["lang", "phrase", "f"]).cast(_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[pa.Table] = []

        def add(texts: pa.Array, tails: np.ndarray, langs: pa.Array, counts: np.ndarray) -> None:
            for table in cut(texts, tails, langs, counts):
                tables.append(table)
                if sum(t.num_rows for t in tables) >= 4 * ROWS:
                    tables[:] = [merged(tables)]

        for batch in batches:
            langs, texts, counts = batch.column("lang"), batch.column("piece"), batch.column("c").to_numpy()
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(size > BYTES):  # a long piece goes in stretches
                for text, tail in _parts(texts[k].as_py(), high - 1):
                    add(pa.array([text]), np.array([tail]), langs.slice(k, 1), counts[k : k + 1])
            brief = np.flatnonzero(size <= BYTES)
            for part in np.split(brief, np.flatnonzero(np.diff(np.cumsum(size[brief]) // BYTES)) + 1):
                if len(part):
                    at = pa.array(part)
                    add(texts.take(at), np.zeros(len(part), np.int64), langs.take(at), counts[part])
            if tables and sum(t.num_rows for t in tables) >= 2 * ROWS:
                yield from _packed(merged(tables), buckets)
                tables.clear()
        if tables:
            yield from _packed(merged(tables), buckets)

    return run


def _spill(folder: str) -> str:
    """A folder of its own for duckdb below the shared one; none where that is not a file system of the machine, so that a bucket has to fit."""
    place = urlparse(folder)
    return tempfile.mkdtemp(prefix="tidemark-duck-", dir=place.path) if place.scheme in ("", "file") and os.path.isdir(place.path) else ""


def _count(least: int, folder: str, totals: bool):
    """Rows (lang, phrase, f) of a bucket, added up out of core in duckdb; those of at least ``least``, and the sum of each language under an empty phrase if ``totals``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import shutil

        import duckdb

        own = _spill(folder)
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": own, "preserve_insertion_order": False})
        try:
            con.execute("CREATE TABLE part (lang VARCHAR, phrase VARCHAR, f BIGINT)")
            for batch in batches:
                for k in range(0, batch.num_rows, 64):
                    con.register("bodies", _unpacked(batch.slice(k, 64)))
                    con.execute("INSERT INTO part SELECT lang, unnest(string_split(phrases, chr(10))), unnest(fs) FROM bodies")
                    con.unregister("bodies")
            counts = f"SELECT lang, phrase, sum(f)::BIGINT AS f FROM part GROUP BY ALL HAVING sum(f) >= {least}"
            if totals:
                counts += " UNION ALL SELECT lang, '', sum(f)::BIGINT FROM part GROUP BY lang"
            yield from con.execute(counts).to_arrow_table().to_batches(1 << 14)
        finally:
            con.close()
            if own:
                shutil.rmtree(own, ignore_errors=True)

    return run


def counted(parts: DataFrame, low: int, high: int, least: int, words=None, pairs=None, totals: bool = False) -> DataFrame:
    """Frequent phrases (lang, phrase, f) of ``low`` to ``high`` words of distinct pieces."""
    spark = parts.sparkSession
    buckets = partitions(spark)
    grams = parts.mapInArrow(_grams(low, high, buckets, words, pairs), "bucket int, lang string, n int, body binary")
    return grams.repartitionById(buckets, "bucket").mapInArrow(_count(least, scratch_dir(spark), totals), "lang string, phrase string, f long")


def _bits(frequent: DataFrame, n: int, size: int):
    """The map of frequent phrases of ``n`` words as a broadcast of ``size`` bits, a power of two: only its 64-bit cells that are not empty reach the driver, as many as it has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("phrase").to_pylist(), batch.column("lang").to_pylist()
            data = "\n".join(texts).encode("utf-8", "surrogatepass")
            lang = np.repeat(np.array([_lang_hash(x) for x in langs], np.uint64), n)
            hashes = _hashes(data, lang)
            hashes = window_hashes(hashes, n)[::n] if n > 1 else hashes
            at = hashes & np.uint64(size - 1)
            cell = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(cell)], ["cell", "bits"])

    cells = frequent.mapInArrow(run, "cell int, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(size >> 6, np.uint64)
    for row in cells.toLocalIterator():
        out[row.cell] = np.array(row.bits, np.int64).view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(out)


def frequencies(docs: DataFrame, most: int = 5, least: int = 100, bits: int = BITS) -> DataFrame:
    """Exact counts (lang, phrase, f) of all phrases of 1 to ``most`` words with f >= ``least``, and of all words of a language under an empty phrase."""
    parts = written(pieces(docs))
    found = [written(counted(parts, 1, 1, least, totals=True))]
    totals = found[0].where("phrase = ''").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))  # a row of each bucket
    words = _bits(found[0].where("phrase <> ''"), 1, bits)
    if most > 1:
        found.append(written(counted(parts, 2, 2, least, words)))
    if most > 2:
        pairs = _bits(found[1], 2, bits)
        found.append(written(counted(parts, 3, most, least, words, pairs)))
        pairs.unpersist()
    words.unpersist()
    out = totals.unionByName(found[0].where("phrase <> ''"))
    for longer in found[1:]:
        out = out.unionByName(longer)
    out = written(out)
    discard(parts, *found)
    return out


def collocations(docs: DataFrame, most: int = 5, least: int = 100, top: int = 2000, percent: int = 100) -> DataFrame:
    """The first ``top`` phrases of each language: rows (lang, rank, phrase, a, l, r, n, score).

    Candidates have 2 to ``most`` words and occur ``least`` times at least. A cut into two parts that occur l and r times has the score
    floor(1000 * a * n / (l * r)), n being the words of the language; the lowest cut counts, the earliest of equal ones. A candidate whose
    words are part of a longer one that has ``percent`` of its occurrences at least goes.
    """
    found = frequencies(docs, most, least)
    words = F.split("phrase", " ")
    known = found.withColumn("size", F.when(F.col("phrase") == "", 0).otherwise(F.size(words)))
    part = lambda first, size: F.array_join(F.slice(words, first, size), " ")
    candidates = known.where("size >= 2").withColumnRenamed("f", "a")
    # what a longer candidate holds, a longer one yet that holds it, holds as well, and is no more frequent: one word more is enough to look at
    inner = candidates.where("size >= 3").select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    candidates = candidates.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {int(percent)} * a").drop("longer")
    cuts = [F.when(F.col("size") > k, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), (part(F.lit(1), F.lit(k)) if side == "l" else part(F.lit(k + 1), F.col("size") - k)).alias("part"))) for k in range(1, most) for side in "lr"]
    whole = F.struct(F.lit(0).alias("k"), F.lit("n").alias("side"), F.lit("").alias("part"))
    requests = candidates.select("lang", "phrase", "a", F.explode(F.array_compact(F.array(whole, *cuts))).alias("x")).select("lang", "phrase", "a", "x.*")
    # words and languages are asked for by many candidates: their counts have SALTS copies, which share the requests
    brief = F.instr("part", " ") == 0
    requests = requests.withColumn("salt", F.when(brief, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    copies = F.when(F.col("size") <= 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    counts = known.select("lang", F.col("phrase").alias("part"), "f", F.explode(copies).alias("salt"))
    answers = requests.join(counts, ["lang", "part", "salt"])
    side = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).cast("decimal(15,0)")
    wide = answers.groupBy("lang", "phrase", "a").agg(side(0, "n").alias("n"), *[side(k, s).alias(f"{s}{k}") for k in range(1, most) for s in "lr"])
    scores = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"(cast(1000 as decimal(4,0)) * (cast(a as decimal(15,0)) * n)) div (l{k} * r{k})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").cast("long").alias("l"), F.col(f"r{k}").cast("long").alias("r"))) for k in range(1, most)]
    scored = wide.select("lang", "phrase", "a", F.col("n").cast("long").alias("n"), F.array_min(F.array_compact(F.array(*scores))).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # no task ranks a whole language: the first of each of 64 parts, then of those
    first = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_k") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
