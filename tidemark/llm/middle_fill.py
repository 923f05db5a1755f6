"""Fill-in-the-middle: a text is cut into prefix, middle and suffix at token bounds and put in another order, with marks.

Tokens are the matches of a pattern that covers every code point. The Split pre-tokenizer of the tokenizers library
gives their code-point offsets, with matches isolated and nothing trained; the number of offsets is n, and the offsets
at two ranks drawn from a hash of doc_id are where the text is cut. Texts are split block by block, between tokens.

Results for odd input: a null text is an empty one; empty texts and texts that hold a mark stay plain, with null
`prefix_chars` and `middle_chars`; a null doc_id draws as if it had no digits; rows that repeat a doc_id are each cut by
its draw; texts of any length are cut as a whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: marks of prefix, suffix and middle, and the token pattern.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TOKEN = r"[A-Za-z]+|[^A-Za-z]"

#: Code points that the pre-tokenizer is given at once, and output bytes that a task holds before it passes them on.
BLOCK = 1 << 9
HELD = 8 << 20


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def blocks(text: str, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ends (start, end) of stretches of about ``size`` code points that no token crosses; a longer run of letters stays whole."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        while end < len(text) and _letter(text[end - 1]) and _letter(text[end]):
            end += 1
        yield start, end
        start = end


def offsets(text: str, split) -> np.ndarray:
    """Code-point offset of the start of every token of ``text``."""
    out = [np.zeros(0, np.int64)]
    for start, end in blocks(text):
        found = split.pre_tokenize_str(text[start:end])
        out.append(np.fromiter((at[0] for _, at in found), np.int64, len(found)) + start)
    return np.concatenate(out)


def draws(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def rearranged(doc_id: int | None, text: str, split, plain: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    starts = offsets(text, split)
    n, (h1, h2, h3, h4) = len(starts), draws(doc_id)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= plain:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(starts[k]) if k < n else len(text) for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_middle(docs: DataFrame, plain: int = 90, spm: int = 20) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output), one for each row of ``docs`` (doc_id, text).

    Of texts that can be cut, ``plain`` in a hundred are, and of those ``spm`` in a hundred have the suffix first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        split = Split(Regex(TOKEN), "isolated")
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py() or ""
                rows.append((doc_id, *rearranged(doc_id, text, split, plain, spm)))
                held += len(text)
                if held >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_middle`` rearranged, from its output and form alone: each mark stands in the output once."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
