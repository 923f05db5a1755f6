"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vectors of an n-gram's letters are rotated by
their place and bound by multiplication; a text is the bundle (sum) of the vectors of its n-grams,
and a language the bundle of its texts. A text gets the language whose prototype has the largest
cosine with it.

Results for odd input: null texts and texts without a letter get `und` and 0.0; so does every text
if nothing can be learnt; equal cosines give the first language in code point order; a text of any length is read whole, in stretches of its
n-grams, and counts in its language's prototype with its length. One row is given
for each row of documents, repeated and null ids included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Code points below this have vectors of their own; others share them by remainder.
LETTERS = 4096
#: Distinct n-grams of the texts that are bundled together, and of those whose vectors are made at once.
GRAMS = 1 << 16
STRETCH = 8192
_NOT_LETTER = np.uint16(0)


def _letter_table() -> np.ndarray:
    """Code point to letter code of its lower case, 0 for all but letters."""
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or c > 0x323AF and c < 0x10FFFF:
            continue
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = 1 + ord(low[0]) % (LETTERS - 1)
    return out


_table: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Letter codes of a text; runs of anything else are one 0 each, as are both ends."""
    if not _table:
        _table.append(_letter_table())
    codes = _table[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate(([_NOT_LETTER], codes, [_NOT_LETTER]))
    return codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]


def grams(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the letters, as numbers of base LETTERS, and how often each occurs."""
    code = letters(text or "").astype(np.int64)
    if not code.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(max(0, len(code) - n + 1), np.int64)
    for k in range(n):
        total = total * LETTERS + code[k : k + len(total)]
    return np.unique(total, return_counts=True)


class Space:
    """Vectors of letters, and of n-grams bound from them."""

    def __init__(self, size: int, n: int, seed: int = 97):
        self.size, self.n = size, n
        letter = np.random.default_rng(seed).integers(0, 2, (LETTERS, size), np.int8) * 2 - 1
        self.placed = [np.roll(letter, n - 1 - k, axis=1) for k in range(n)]

    def bound(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), self.size), np.int8)
        for k in range(self.n):
            out *= self.placed[k][(codes // LETTERS ** (self.n - 1 - k)) % LETTERS]
        return out.astype(np.float32)

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text, zero for texts without a letter: counts of distinct n-grams times the vectors of those.

        Texts are taken together while they have at most GRAMS n-grams; one with more is taken alone, a stretch of n-grams at a time.
        """
        out = np.zeros((len(texts), self.size), np.float32)
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            every, place = np.unique(np.concatenate([c for _, c, _ in held]), return_inverse=True)
            ends = np.cumsum([0, *[len(c) for _, c, _ in held]])
            counts = np.zeros((len(held), len(every)), np.float32)
            for i, (_, _, n) in enumerate(held):
                counts[i, place[ends[i] : ends[i + 1]]] = n
            rows = [i for i, _, _ in held]
            for k in range(0, len(every), STRETCH):
                out[rows] += counts[:, k : k + STRETCH] @ self.bound(every[k : k + STRETCH])
            held.clear()

        for i, text in enumerate(texts):
            codes, n = grams(text, self.n)
            if len(codes) > GRAMS:
                for k in range(0, len(codes), STRETCH):
                    out[i] += n[k : k + STRETCH].astype(np.float32) @ self.bound(codes[k : k + STRETCH])
                continue
            if held and (len(held) == 64 or sum(len(c) for _, c, _ in held) + len(codes) > GRAMS):
                flush()
            held.append((i, codes, n))
        if held:
            flush()
        return out


def _prototypes(size: int, n: int):
    """Rows (text, lang) to (lang, place, total): what a task's texts add to each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(size, n), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            vectors = space.bundles(batch.column("text").to_pylist())
            for lang in set(langs):
                rows = vectors[[x == lang for x in langs]].astype(np.float64).sum(axis=0)
                sums[lang] = sums.get(lang, 0.0) + rows
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array(np.arange(size, dtype=np.int32)), pa.array(v)], ["lang", "place", "total"])

    return run


def learn(docs: DataFrame, size: int = 1024, n: int = 3) -> tuple[list[str], np.ndarray]:
    """Languages and unit prototypes of all rows of ``docs`` (text, lang): a vector for each language reaches the driver."""
    rows = docs.where("lang is not null and text is not null").select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_prototypes(size, n), "lang string, place int, total double")
    found: dict[str, np.ndarray] = {}
    for r in rows.groupBy("lang", "place").agg(F.sum("total").alias("total")).toLocalIterator():
        found.setdefault(r.lang, np.zeros(size))[r.place] = r.total
    names = sorted(k for k, v in found.items() if v.any())
    return names, np.array([found[k] / np.linalg.norm(found[k]) for k in names]).reshape(len(names), size)


def languages(docs: DataFrame, size: int = 1024, n: int = 3) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each row of ``docs`` (doc_id, text, lang).

    Learns from all documents whose id has another crc32 remainder of 3 than 1; the score is the cosine, at least 0.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    names, prototypes = learn(docs.where(fold("doc_id", 3) != 1), size, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(size, n)
        for batch in batches:
            vectors = space.bundles(batch.column("text").to_pylist()).astype(np.float64)
            length = np.linalg.norm(vectors, axis=1)
            if names:
                cosine = vectors @ prototypes.T / np.maximum(length, 1e-12)[:, None]
                best = cosine.argmax(axis=1)
                score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
            lang = [names[best[i]] if names and x > 0 else "und" for i, x in enumerate(length)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.where(length > 0, score, 0.0) if names else np.zeros(len(length)))], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
