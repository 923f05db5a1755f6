"""Main text of web pages by equivalence classes of template tokens.

The tokens of a page are its tags, told apart by the containers around them, and its text blocks. Over all pages of a host
the occurrence vector of each token (how often it stands in each page) is folded into a page count, a sum and an
order-free 64-bit signature; tokens of one host with equal vectors form an equivalence class. Classes of at least
``least_tokens`` tokens on at least half of the host's pages (and ``least_pages``) are its template. On each page a class is valid if its
tokens come in one order, again and again; valid classes are nested: a tuple of one may hold whole tuples of another, never a
part. The gaps between template tokens are the slots.

Text blocks that are template tokens themselves are no data outside articles. What is left of a slot (what follows a template token within a container,
all over the page) is judged as a whole: text that lies in a menu, header, footer, sidebar, notice, advert, form, script, style or comment
section (by tag, role, class or id) has no weight, text in an article or main element most, then text in elements named so. Slots whose
mean weight comes near that of the best slot stay; where no slot has more than plain weight, those of them with most unlinked text or headings.
A class or id around an article does not erase the article, and what names and tags say is held against the text (``weigh``). On hosts with fewer than ``least_pages`` pages a slot is a container.

Results for odd input: null and empty html and pages without main text give an empty text; a null or malformed url counts as one host
without a name; slots of equal worth all stay; unclosed tags, quotes and comments cost no more than their length; repeated rows and null page ids keep a row each; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import html as html_references
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, written

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements and names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = BLOCKS - frozenset("br hr p li dd dt h1 h2 h3 h4 h5 h6 option".split()) | frozenset("noscript template svg canvas object video audio label".split())
CLUTTER_TAGS = frozenset("head nav aside footer dialog menu search button select option label fieldset noscript template svg canvas object video audio".split())
CLUTTER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
CLUTTER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notices banner alert popup modal overlay newsletter subscribe subscription signup login paywall comment comments reply replies respond disqus share sharing social related recommended recommendations widget widgets pagination pager search form copyright toolbar skip".split()
)
#: Words that say nothing of what a part is; in an article, a name is one of clutter only if all its other words are.
PLACE_NAMES = frozenset(
    "area bar block body bottom box btn button buttons card cards col component container content element field frame grid group holder icon icons inline inner item items left link links list module outer panel placeholder post posts primary region right row secondary section slot small text title top unit wrap wrapper zone".split()
)
HEADER_NAMES = frozenset("header masthead topbar".split())
COMMENT_NAMES = frozenset("comment comments reply replies respond disqus".split())
#: Weights of text in an article or main element, in one that is named so, and elsewhere.
MAIN, NAMED, PLAIN = 12.0, 4.0, 1.0
WEIGHTS = (PLAIN, NAMED, MAIN)
CONTENT_NAMES = frozenset("article articlebody content maincontent post entry story main".split())


def _mark(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def host_of(url: str | None) -> str:
    rest = (url or "").partition("//")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


@dataclass
class Block:
    text: str
    key: str  # of the text as a token
    path: str  # of its container
    clutter: int  # 2: by a tag, a role or as a comment section, 1: by a name, 0: not
    scope: int  # 2: in an article or main element, 1: in one that is named so
    form: bool  # in a form
    lifted: bool  # in an article that a name of clutter stands around
    linked: int  # characters in links
    tags: int  # tags of the page before it
    heading: bool
    weight: float  # of the text in its slot, by tags and names alone until weigh() sees the page

    @property
    def plain(self) -> int:
        return max(0, len(self.text) - self.linked)


@dataclass
class Page:
    tags: list[str] = field(default_factory=list)  # keys of tags, in order
    blocks: list[Block] = field(default_factory=list)


def _names(value: str) -> list[list[str]]:
    return [[x.lower() for x in _NAME_PART.findall(name)] for name in value.split()]


def _kind(tag: str, attributes: str, scope: int) -> tuple[int, int, str]:
    """Whether an element is clutter by itself (2: by its tag, role or as a comment section, 1: by another name), its scope, and its key in paths."""
    if not attributes.strip() or tag in ("html", "body", "head"):
        own = {}
    else:
        own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    names = _names(own.get("class", "")) + _names(own.get("id", ""))
    role, place = own.get("role", "").lower(), 2 if tag in ("article", "main") else 0
    if role in ("main", "article") or own.get("itemprop", "").lower() == "articlebody":
        place = 2
    parts = {x for n in names if n and not {"with", "has", "no", "without", "layout"} & set(n) for x in n}
    if not place and (parts & CONTENT_NAMES):
        place = 1
    if scope == 2:
        named = any(set(n) & CLUTTER_NAMES and set(n) <= CLUTTER_NAMES | PLACE_NAMES for n in names) and tag not in ("article", "main")
        parts = {x for n in names if set(n) <= COMMENT_NAMES | PLACE_NAMES | {"section", "thread"} for x in n}
    else:
        named = bool(parts & CLUTTER_NAMES) and tag not in ("article", "main")
    if scope < 2 and place < 2:
        named = named or tag == "header" or bool(parts & HEADER_NAMES)
    hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
    firm = tag in CLUTTER_TAGS or role in CLUTTER_ROLES and not (role == "banner" and scope == 2) or hidden or parts & COMMENT_NAMES
    return 2 if firm else 1 if named else 0, place, tag + "".join("." + "-".join(n) for n in sorted(names) if n)


class _Tags:
    """The next tag from a place on, in time that grows with the length of the page, whatever it leaves open."""

    def __init__(self, html: str):
        self.html = html
        self.last = html.rfind(">")
        self._lost: set[int] = set()  # quotes that open outside others, after which no tag ends

    def end(self, at: int) -> int:
        """Where a tag whose attributes begin at ``at`` ends: at the first > outside quotes, or if there is none at the first; -1 without any."""
        if at > self.last:
            return -1
        seen, place = [], at
        while True:
            found = _MARK.search(self.html, place)
            if found is None or found.start() in self._lost:
                break
            if found[0] == ">":
                return found.start()
            seen.append(found.start())
            close = self.html.find(found[0], found.end())
            if close < 0:
                break
            place = close + 1
        self._lost.update(seen)
        return self.html.find(">", at)


def parse(html: str | None) -> Page:
    """Tags and text blocks of a page, in order; unclosed and misplaced tags are taken as browsers mostly do."""
    page, at, html = Page(), 0, html or ""
    tags = _Tags(html)
    stack: list[tuple[str, str, int, int, bool, bool]] = [("", "", 0, 0, False, False)]  # tag, path, clutter, scope, form, lifted
    open_tags: Counter[str] = Counter()
    runs: list[str] = []
    links = linked = 0
    heading = False

    def close() -> None:
        nonlocal linked
        text = " ".join(html_references.unescape("".join(runs)).split()) if runs else ""
        if text:
            _, path, clutter, scope, form, lifted = stack[-1]
            page.blocks.append(Block(text, f"T{path}|{text}", path, clutter, scope, form, lifted, linked, len(page.tags), heading, 0.0 if clutter or form else WEIGHTS[scope]))
        runs.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        runs.append(text)
        linked += len(text.strip()) if links else 0

    while at < len(html):
        begin = html.find("<", at)
        if begin < 0:
            begin = len(html)
        if begin > at:
            add(html[at:begin])
            at = begin
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(html)
            continue
        if html[at + 1 : at + 2] in ("!", "?") and at < tags.last:
            at = html.find(">", at) + 1
            continue
        m = _NAME.match(html, at + 1)
        end = tags.end(m.end()) if m else -1
        if end < 0:
            add("<")
            at += 1
            continue
        at = end + 1
        tag, ends, attributes = m[2].lower(), bool(m[1]), html[m.end() : end]
        if tag == "a":
            links = 0 if ends else 1
        if tag in RAW and not ends:
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            stop = html.find(">", found.end()) if found else -1
            at = stop + 1 if stop >= 0 else len(html)
            page.tags.append(f"S{stack[-1][1]}|{tag}")
            continue
        if tag in BLOCKS:
            close()
            if not ends and stack[-1][0] == "p":
                open_tags[stack.pop()[0]] -= 1
        if tag[0] == "h" and tag[1:].isdigit():
            heading = not ends
        if ends:
            if open_tags[tag]:
                close()
                while stack[-1][0] != tag:
                    open_tags[stack.pop()[0]] -= 1
                open_tags[stack.pop()[0]] -= 1
            page.tags.append(f"E{stack[-1][1]}|{tag}")
            continue
        _, path, clutter, scope, form, lifted = stack[-1]
        own, place, key = _kind(tag, attributes, scope)
        page.tags.append(f"S{path}|{key}")
        if tag not in VOID and not attributes.rstrip().endswith("/") and (tag in CONTAINERS or own):
            if own and tag not in BLOCKS:
                close()
            # a name around an article says nothing of the article; within it names count again
            lift = place == 2 and scope < 2 and clutter == 1
            stack.append((tag, f"{_mark(f'{path}/{key}'):x}", max(0 if lift else clutter, own), max(scope, place), form or tag == "form", lifted or lift))
            open_tags[tag] += 1
    close()
    return page


def weigh(blocks: list[Block]) -> list[Block]:
    """``blocks`` with the weight of their text in a slot: none for clutter, most in an article or main element, more in elements that are named so.

    What names and tags say is held against the text. A form that holds the page is none. Names of clutter in an article are none if they hold
    more of its text than all else. Articles inside clutter count only if they are more than the text outside, and articles of
    less than half the other text are teasers.
    """
    free = [b for b in blocks if b.clutter < 2]
    inside, outside = (sum(b.plain for b in free if not b.clutter and b.form == f) for f in (True, False))
    whole_form = inside > 4 * outside
    free = [b for b in free if whole_form or not b.form]
    named, rest = (sum(b.plain for b in free if b.scope == 2 and bool(b.clutter) == c) for c in (True, False))
    free = [b for b in free if not b.clutter or b.scope == 2 and named > rest and not b.lifted]
    lifted, others = (sum(b.plain for b in free if b.lifted == x) for x in (True, False))
    if lifted < others:
        free = [b for b in free if not b.lifted]
    articles, others = (sum(b.plain for b in free if (b.scope == 2) == x) for x in (True, False))
    teasers = 2 * articles < others
    for b in blocks:
        b.weight = 0.0
    for b in free:
        b.weight = 0.0 if teasers and b.scope == 2 else WEIGHTS[b.scope]
    return blocks


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html) to (site, token, text, n, c, x): what these pages add to the occurrence vectors; token 0 is the page."""
    have: dict[tuple[int, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        columns = [[k[0] for k in have], [k[1] for k in have], *([v[i] for v in have.values()] for i in range(4))]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["site", "token", "text", "n", "c", "x"])
        have.clear()
        return batch

    for batch in batches:
        for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
            html, site = html.as_py(), _signed(_mark(host_of(url.as_py())))
            if not html:
                continue
            page = parse(html)
            seed = f"{page_id.as_py()}|{len(html)}|{url.as_py()}"
            counts = Counter(page.tags)
            texts = Counter(b.key for b in page.blocks)
            rows = [(0, 0, 1)] + [(_signed(_mark(k)) or 1, 0, n) for k, n in counts.items()] + [(_signed(_mark(k)) or 1, 1, n) for k, n in texts.items()]
            marks = {n: _signed(_mark(f"{seed}|{n}")) for n in {r[2] for r in rows}}
            for token, text, n in rows:
                v = have.setdefault((site, token), [text, 0, 0, 0])
                v[1] += 1
                v[2] += n
                v[3] = _signed(v[3] + marks[n])
        if len(have) > 200_000:
            yield out()
    yield out()


def _wrapped_sum(column: str):
    """Sum modulo 2^64 of signed 64-bit numbers, in halves that cannot overflow; repeated pages add up."""
    low = F.sum(F.col(column).bitwiseAND(F.lit((1 << 32) - 1)))
    high = F.sum(F.shiftright(column, 32))
    return F.shiftleft((high + F.shiftright(low, 32)).bitwiseAND(F.lit((1 << 32) - 1)), 32).bitwiseOR(low.bitwiseAND(F.lit((1 << 32) - 1)))


def templates(pages: DataFrame, least_tokens: int = 3, least_pages: int = 5, text_pages: int = 10) -> DataFrame:
    """(site, tokens, classes): the template tokens of each host with the number of their class; constant texts need ``text_pages`` pages."""
    vectors = pages.select("page_id", "url", "html").mapInArrow(_counted, "site long, token long, text int, n long, c long, x long")
    vectors = vectors.groupBy("site", "token").agg(F.max("text").alias("text"), F.sum("n").alias("n"), F.sum("c").alias("c"), _wrapped_sum("x").alias("x"))
    vectors = written(vectors.where(F.col("n") >= least_pages))
    sites = vectors.where("token = 0").select("site", F.col("n").alias("pages"))
    often = vectors.where((F.col("token") != 0) & ((F.col("text") == 0) | (F.col("n") >= text_pages))).join(sites, "site").where(2 * F.col("n") >= F.col("pages"))
    classes = often.groupBy("site", "n", "c", "x").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") >= least_tokens)
    classes = classes.select("site", F.explode("tokens").alias("token"), F.xxhash64("n", "c", "x").alias("class"))
    out = classes.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("token", "class"))).alias("t"))
    return written(out.select("site", F.col("t.token").alias("tokens"), F.col("t.class").alias("classes")))


def nested(seen: list[tuple[int, int, int]]) -> set[int]:
    """Classes that are valid on a page and nest, from its template tokens (position, token, class).

    Tuples that are kept nest, so each position has one innermost tuple around it; another class nests with them if both ends of
    each of its tuples have the same one.
    """
    by: dict[int, list[tuple[int, int]]] = {}
    for at, (_, token, cls) in enumerate(seen):
        by.setdefault(cls, []).append((at, token))
    spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for cls, rows in by.items():
        order = [t for _, t in rows]
        k = len(set(order))
        if len(order) % k == 0 and order == order[:k] * (len(order) // k):
            places = np.array([at for at, _ in rows])
            spans[cls] = places[::k], places[k - 1 :: k]
    inner, names = np.zeros(len(seen), np.int64), 1
    kept: set[int] = set()
    for cls in sorted(spans, key=lambda c: (len(spans[c][0]), -len(by[c]), c)):
        start, end = spans[cls]
        if (inner[start] != inner[end]).any():
            continue
        kept.add(cls)
        size = end - start + 1
        of = np.repeat(np.arange(len(start)), size)
        place = np.arange(len(of)) + np.repeat(start - np.cumsum(size) + size, size)
        own = inner[place] == inner[start][of]
        inner[place[own]] = names + of[own]
        names += len(start)
    return kept


def main_text(html: str | None, template: dict[int, int]) -> str:
    """The text of a page, given the classes of its host's template tokens.

    A slot is what follows a template token within one container, wherever that stands on the page again. It is worth the mean weight
    of its text, and is kept if that comes near the best slot's; where no slot stands out, those with most unlinked text and with headings are kept.
    """
    page = parse(html)
    if not page.blocks:
        return ""
    weigh(page.blocks)
    seen, block = [], 0
    keys = [_signed(_mark(b.key)) or 1 for b in page.blocks] if template else []
    tags = {k: _signed(_mark(k)) or 1 for k in set(page.tags)} if template else {}
    for i in range(len(page.tags) + 1 if template else 0):
        while block < len(page.blocks) and page.blocks[block].tags == i:
            if keys[block] in template:
                seen.append((len(seen), keys[block], template[keys[block]]))
            block += 1
        if i < len(page.tags) and (t := tags[page.tags[i]]) in template:
            seen.append((len(seen), t, template[t]))
    valid = nested(seen) if seen else set()
    used = {t for _, t, c in seen if c in valid}
    data = [b for b in page.blocks if b.weight]
    # a text that repeats over the host is no data, unless it stands in an article
    left = [b for b in data if b.weight > PLAIN or not used or (_signed(_mark(b.key)) or 1) not in used] or data
    marks = [i + 1 for i, t in enumerate(page.tags) if tags.get(t) in used]
    slots: dict[tuple[str, str], list[Block]] = {}
    of = []
    for b in left:
        k = bisect_right(marks, b.tags)
        of.append((page.tags[marks[k - 1] - 1] if k else "", b.path))
        slots.setdefault(of[-1], []).append(b)
    size = {s: sum(len(b.text) for b in bs) for s, bs in slots.items()}
    plain = {s: sum(b.plain for b in bs) for s, bs in slots.items()}
    worth = {s: sum(b.weight * len(b.text) for b in bs) / size[s] for s, bs in slots.items()}
    best = max(worth.values(), default=0)
    good = {s for s in slots if worth[s] >= 0.5 * best}
    if best == PLAIN:
        most = max((plain[s] for s in good), default=0)
        good = {s for s in good if 3 * plain[s] >= 2 * size[s] and (5 * plain[s] >= most or any(b.heading for b in slots[s]))}
    return "\n".join(b.text for b, s in zip(left, of, strict=True) if s in good)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[int, dict[int, int]] = {}
    for batch in batches:
        out = []
        for site, html, tokens, classes in zip(*(batch.column(c) for c in ("site", "html", "tokens", "classes")), strict=True):
            key = site.as_py()
            if key not in kept:
                if len(kept) > 5_000:
                    kept.clear()
                kept[key] = dict(zip(tokens.as_py() or [], classes.as_py() or [], strict=True))
            out.append(main_text(html.as_py(), kept[key]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def _sited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        site = pa.array([_signed(_mark(host_of(u.as_py()))) for u in batch.column("url")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("html"), site], ["page_id", "url", "html", "site"])


def page_texts(pages: DataFrame, **settings) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of ``pages`` (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = templates(pages, **settings)
    size = found.agg(F.sum(F.size("tokens") * 16 + 64)).first()[0] or 0
    rows = pages.mapInArrow(_sited, "page_id long, url string, html string, site long")
    rows = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "site", "left")
    out = rows.select("page_id", "url", "html", "site", "tokens", "classes").mapInArrow(_texts, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
