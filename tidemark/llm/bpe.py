"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its inverse.

The merges of a proper list (both sides of every merge are made by earlier merges or are single bytes) reach only so far: whether
there is a token bound at some place of a word depends on a bounded number of bytes after it. `lookahead` computes that
number from the list. A word is read in blocks; the tokens that end further back than it are final and leave, the bytes after
them stay. So a word of any length takes the memory of a block. Words are found in blocks of text in the same way: what the
next block could still change waits for it.

Results for odd input: a null or empty text has no ids and decodes to an empty text; rows that repeat a doc_id are each
encoded, null ids included; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of text taken at once; words of at most SHORT code points are remembered, WORDS of them at most.
BLOCK = 1 << 16
SHORT = 48
WORDS = 1 << 18
#: Bytes of output that a task holds before it passes them on.
HELD = 8 << 20
#: Fixed values of the file format: the end of a word, and the pattern of words (white space is in none).
END = "</w>"
SHORT_FORMS = "'s|'t|'re|'ve|'m|'ll|'d"


@lru_cache(1)
def class_ranges() -> tuple[str, str, str]:
    """Letters, numbers and white space, as the tokenizers library sees the code points: ranges of a character class each."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    found = [Split(Regex(f"[^{kind}]+"), "removed").pre_tokenize_str(every) for kind in (r"\p{L}", r"\p{N}", r"\s")]
    return tuple("".join(f"\\U{ord(x[0]):08x}-\\U{ord(x[-1]):08x}" for x, _ in f) for f in found)


class Classes:
    """Patterns of words, letters and the rest among code points below ``end``: short classes are faster, and most texts need no others."""

    def __init__(self, ranges: tuple[str, str, str], end: int):
        letter, number, space = ("".join(f"\\U{a:08x}-\\U{min(b, end - 1):08x}" for a, b in _pairs(r) if a < end) for r in ranges)
        other = f"[^{letter}{number}{space}]"
        self.word = re.compile(f"[{letter}]+|[{number}]|{SHORT_FORMS}|{other}+")
        self.letters, self.others, self.space = re.compile(f"[{letter}]+"), re.compile(f"{other}+"), re.compile(f"[{space}]")

    def a_space(self, text: str, reach: int) -> int:
        """A place of white space among the last ``reach`` code points, or 0."""
        at = text.rfind(" ")
        if at < 0 or len(text) - at > reach:
            at = 0
            for found in self.space.finditer(text, max(0, len(text) - reach)):
                at = found.start()
        return at


def _pairs(ranges: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\U(\w{8})-\\U(\w{8})", ranges)]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: its own where that is a visible Latin-1 letter, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    own = set(seen)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Bytes after a place of a word that can decide whether a token ends there.

    Two texts that are the same up to some place can only differ before it by a merge over that place in one of them, which takes
    the token on its left: a merge (u, v) moves the difference back by the length of u. A later merge moves it on only if its
    right side starts with that token, as the leftmost token of what it was merged from. So the reach is the heaviest
    chain of merges in order, each weighing its left side, where the left side of one is at the left edge of the right side of the next.
    """
    made = {u + v: (u, v) for u, v in merges}
    chains: dict[str, int] = {}
    for u, v in merges:
        if u.endswith(END):
            continue
        before, edge = 0, v
        while True:
            before = max(before, chains.get(edge, 0))
            if edge not in made:
                break
            edge = made[edge][0]
        chains[u] = max(chains.get(u, 0), before + len(u))
    return max(chains.values(), default=0)


def _proper(merges: list[tuple[str, str]]) -> bool:
    """Whether every token has one merge, which comes after those of its sides."""
    made: set[str] = set()
    for u, v in merges:
        if any(len(x.removesuffix(END) or END) > 1 and x not in made for x in (u, v)) or u + v in made:
            return False
        made.add(u + v)
    return True


class Merges:
    """A merge list by ids, and the transducer over the bytes of one word."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or not _proper(merges):
            raise ValueError("not a proper list of byte-pair merges with word ends")
        letters = byte_letters()
        self.inner, self.last = [self.vocab[c] for c in letters], [self.vocab[c + END] for c in letters]
        self.rank = {(self.vocab[u], self.vocab[v]): k for k, (u, v) in enumerate(merges)}
        self.made = [self.vocab[u + v] for u, v in merges]
        self.size = {i: len(t.removesuffix(END)) for t, i in self.vocab.items()}
        self.reach = lookahead(merges)

    def apply(self, ids: list[int]) -> list[int]:
        """All merges over a list of ids, the earliest of the list first, then the leftmost."""
        if len(ids) < 2:
            return ids
        if len(ids) <= SHORT:
            ids, rank, none = list(ids), self.rank.get, len(self.made)
            ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) < none:
                at = ranks.index(best)
                ids[at : at + 2] = [self.made[best]]
                del ranks[at]
                if at:
                    ranks[at - 1] = rank((ids[at - 1], ids[at]), none)
                if at < len(ranks):
                    ranks[at] = rank((ids[at], ids[at + 1]), none)
            return ids
        n, ids = len(ids), list(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k, pair in enumerate(zip(ids, ids[1:])) if (r := self.rank.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            if ids[k] < 0 or (j := after[k]) >= n or self.rank.get((ids[k], ids[j])) != rank:
                continue
            ids[k], ids[j] = self.made[rank], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (r := self.rank.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k))
            if (i := before[k]) >= 0 and (r := self.rank.get((ids[i], ids[k]))) is not None:
                heapq.heappush(heap, (r, i))
        return [x for x in ids if x >= 0]


class Word:
    """The transducer over one word: bytes in, ids out as soon as no later byte can change them."""

    def __init__(self, merges: Merges):
        self.merges, self.held, self.block = merges, bytearray(), 4 * merges.reach + 64

    def feed(self, part: bytes) -> list[int]:
        m, out = self.merges, []
        for at in range(0, len(part), self.block):
            self.held += part[at : at + self.block]
            if len(self.held) < self.block:
                continue
            final, end = len(self.held) - 1 - m.reach, 0  # the last byte may still turn out to end the word
            for x in m.apply([m.inner[b] for b in self.held]):
                if end + m.size[x] > final:
                    break
                end += m.size[x]
                out.append(x)
            del self.held[:end]
        return out

    def end(self) -> list[int]:
        m, held = self.merges, self.held
        return m.apply([*(m.inner[b] for b in held[:-1]), m.last[held[-1]]]) if held else []


@lru_cache(1)
def _joins() -> frozenset[str]:
    """Characters of no combining class that NFC can join to the one before them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    found = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    return frozenset(found | {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]})


def normalized(text: str, normal, size: int = BLOCK) -> Iterator[str]:
    """NFC in lower case, in blocks; each starts with a character that NFC does not join to the one before."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        while end < len(text) and not text[end].isascii() and (unicodedata.combining(text[end]) or text[end] in _joins() or unicodedata.category(text[end]) == "Cn"):
            end += 1
        block = text[start:end]
        yield block.lower() if block.isascii() else normal(block)
        start = end


class Encoder:
    """Text to ids: special tokens, then words, then the transducer of each."""

    def __init__(self, spec: dict):
        from tokenizers.normalizers import NFC, Lowercase, Sequence

        self.merges, ranges = Merges(spec), spec.get("classes") or class_ranges()
        self._ascii, self._low, self._all = (Classes(ranges, end) for end in (0x80, 0x10000, 0x110000))
        self._normal = Sequence([NFC(), Lowercase()]).normalize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or "(?!)")
        self.words: dict[str, list[int]] = {}

    def _word(self, word: str) -> list[int]:
        found = self.words.get(word)
        if found is None:
            run = Word(self.merges)
            found = run.feed(word.encode()) + run.end()
            if len(word) <= SHORT:
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[word] = found
        return found

    def _kinds(self, text: str) -> Classes:
        """The shortest classes that know every code point of a text."""
        return self._ascii if text.isascii() else self._low if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else self._all

    def _words(self, words: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self._word, words)))

    def plain(self, text: str, size: int = BLOCK, long: int = 4096) -> Iterator[list[int]]:
        """Ids of a text without special tokens, block by block. A word of over ``long`` code points at the end of a block is read on as a run."""
        run, letters, held = None, False, ""
        for block in normalized(text, self._normal, size):
            block, held = held + block, ""
            kinds = self._kinds(block)
            if run:
                end = found.end() if (found := (kinds.letters if letters else kinds.others).match(block)) else 0
                yield run.feed(block[:end].encode())
                if end == len(block):
                    continue
                yield run.end()
                run, block = None, block[end:]
            space = kinds.a_space(block, long)
            if len(block) - space <= long:
                yield self._words(kinds.word.findall(block[:space]))
                held = block[space:]
                continue
            done, at = [], len(block)
            for found in kinds.word.finditer(block):
                word = found.group()
                short = word[0] == "'" and word[-1].isalpha()
                if not short and (found.end() == len(block) or found.start() + 3 > len(block)):  # what follows may lengthen it, or make it short for a verb
                    at = found.start()
                    break
                done.append(word)
            yield self._words(done)
            if at + 3 > len(block):
                held = block[at:]
            else:
                run, letters = Word(self.merges), kinds.letters.match(block, at) is not None
                yield run.feed(block[at:].encode())
        if run:
            yield run.end()
        yield self._words(self._kinds(held).word.findall(held))

    def ids(self, text: str) -> np.ndarray:
        out, at = [], 0
        for found in [*self._special.finditer(text), None]:
            out += [np.array(x, "<u4") for x in self.plain(text[at : found.start() if found else len(text)]) if x]
            if found:
                out.append(np.array([self.special[found.group()]], "<u4"))
                at = found.end()
        return np.concatenate(out) if out else np.zeros(0, "<u4")


class Decoder:
    """Ids to text: a state machine over the bytes of tokens, which holds what is left of a character between calls.

    Without a decoder in the file, tokens keep their letters and stand apart by a space; with a byte-level one their letters are bytes.
    """

    def __init__(self, spec: dict):
        tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"no decoder {kind}")
        value = {c: b for b, c in enumerate(byte_letters())}
        raw = (lambda t: bytes(value[c] for c in t) if all(c in value for c in t) else t.encode()) if kind else str.encode
        self.bytes = [raw(tokens.get(i, "")) for i in range(max(tokens) + 1)]
        self.gap = b"" if kind else b" "
        self.restart()

    def restart(self) -> None:
        self._began, self._state = False, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        """Text of the characters that these ids complete."""
        data = self.gap.join(map(self.bytes.__getitem__, ids.tolist()))
        if len(ids) and self._began:
            data = self.gap + data
        self._began = self._began or len(ids) > 0
        return self._state.decode(data)

    def end(self) -> str:
        out = self._state.decode(b"", True)
        self.restart()
        return out

    def text(self, ids: np.ndarray, step: int = BLOCK) -> str:
        return "".join([self.feed(ids[k : k + step]) for k in range(0, len(ids), step)]) + self.end()


_made: dict[tuple[type, str], object] = {}


def _of(kind: type, spec: str):
    """One encoder or decoder for each file and worker."""
    if (kind, spec) not in _made:
        _made.clear()
        _made[kind, spec] = kind(json.loads(spec))
    return _made[kind, spec]


def _mapped(kind: type, spec: str, source: str, turn, schema: pa.Schema):
    """Rows (doc_id, source) to rows of ``schema``, in batches of about HELD bytes; the file comes once to each executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, rows, held = _of(kind, spec.value), [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id"), batch.column(source), strict=True):
                rows.append((doc_id.as_py(), *turn(machine, value.as_py())))
                held += len(rows[-1][-1])
                if held >= HELD:
                    yield pack()
                    rows, held = [], 0
        if rows:
            yield pack()

    return run


def _file(df: DataFrame, path: str):
    """The tokenizer file, of fixed size, and the classes of code points, for the tasks of ``df``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f) | {"classes": class_ranges()}
    return df.sparkSession.sparkContext.broadcast(json.dumps(spec))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids), one for each row of ``docs`` (doc_id, text); ids are unsigned 32-bit integers, little-endian."""

    def turn(encoder: Encoder, text: str | None) -> tuple[int, bytes]:
        ids = encoder.ids(text or "")
        return len(ids), ids.tobytes()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_mapped(Encoder, _file(docs, path), "text", turn, schema), "doc_id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, text) of rows (doc_id, ids) as ``encode`` gives them."""

    def turn(decoder: Decoder, ids: bytes | None) -> tuple[int, bytes, str]:
        ids = ids or b""
        return len(ids) // 4, ids, decoder.text(np.frombuffer(ids, "<u4"))

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])
    return tokens.select("doc_id", "ids").mapInArrow(_mapped(Decoder, _file(tokens, path), "ids", turn, schema), "doc_id long, n_tokens long, ids binary, text string")
