"""Main text of web pages: page structure first, then a suffix array over each host.

A page is read tag by tag into blocks. Scripts, styles, menus, headers, footers,
sidebars, notices, adverts, forms and reader comments are left out by their elements
or by the words of their class, id and role; inside an article a class or id counts only if
all its words do, so that its sections stay. Formulas are text, drawings are not. If a page marks its article (``article``,
``main``, role main), the blocks inside are its text and nothing of them is dropped:
copied articles are common, so repetition says nothing against them. Several articles beside a
longer text outside of them are teasers; such a page marks no article.

Pages that mark no article keep all other blocks for the second step. Each distinct page becomes
a stream of words with a mark around every block, and suffix arrays over the streams of a host
find what repeats. One array over a host would pass through one machine, so the streams are cut
first: each stretch of ``REACH`` tokens chooses an anchor, the leftmost of its three-token
grams with the least hash. That depends on the stretch alone, so equal stretches meet under one
anchor, and the pieces around an anchor hold all of its stretches. Pieces that are equal as a
whole are one row with the number of their pages; a suffix array per pool of anchors puts equal
stretches side by side, and their pages add up to the distinct pages of the whole host.

Near copies of an article repeat as well, so a repeated stretch goes only if the pages that hold
it differ otherwise. A page's own words are those no repeated stretch covers; pages with own words
have a vote, which those with the same own words share. A stretch goes with the votes of ``LEAST_PAGES`` pages
whose own words are half of the page at least, or ``MANY_PAGES`` where they are an eighth. Of what such stretches
cover, whole blocks go from ``LEAST_WORDS`` words on, and any run of ``LONG_RUN`` words from stretches
that ``LEAST_SHARE`` of the host's votes hold. The rest stays. The count is made twice,
the second time without the words that the first one has found.

Null html counts as empty and gives an empty text. Pages of any length are read whole;
broken markup is read as far as it goes. Repeated rows each keep their row, and as copies
of one page they count as one page.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from contrail.session import written

LEAST_WORDS = 6
LONG_RUN = 12
LEAST_PAGES = 3
MANY_PAGES = 20
LEAST_SHARE = 0.05
REACH = 8  # tokens of a stretch: a block of LEAST_WORDS words with its marks
GRAM = 3
KEY_PIECES = 4096  # different pieces of one anchor that go into a suffix array together
POOL_TOKENS = 200_000  # of one suffix array, one anchor more at most
MARK = "\n"  # around blocks; no word holds white space
VOTE = 1 << 32

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# their content is no markup (the second kind's is, but no text of the page); formulas are text, but for their sources
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
HIDDEN = frozenset("noscript template svg annotation annotation-xml".split())
FOREIGN = frozenset("svg annotation annotation-xml".split())  # "/>" ends these at once
SKIPPED = frozenset("head nav footer aside form menu dialog select button".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notification popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget "
    "toolbar pagination pager copyright disclaimer comment comments commentlist disqus reply replies "
    "respond search skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
STATE_WORDS = frozenset("has with without no not is".split())  # "has-sidebar" is no sidebar
# what such a class may say besides inside an article: a part that is no such word makes it another class
PLAIN_WORDS = frozenset(
    "area bar block body bottom box button buttons container content cta end footer form group header icons inline inner "
    "item items js label left link links list main module outer panel post posts right row section side site slot small "
    "start text thread title top unit wrap wrapper".split()
)
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

# what ends a list item, option or paragraph that was left open: the next one, unless other structure is open between
OPTIONAL = {"li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "optgroup": ("option",)}
OPTIONAL |= dict.fromkeys(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split(),
    ("p",),
)
ENDS = frozenset("li option dt dd p".split())
# what keeps the items outside of it open, for the start of a next item and for an end tag
BETWEEN = BLOCKS - frozenset("address br dd div dt hr html body li option p".split())
LISTS = frozenset("ul ol menu dir dl select table caption td th".split())

_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
# starts, with what ends them at once, and ends of an element that may hold itself
_NESTED = {name: re.compile(rf"<(/?){name}(?=[\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>", re.I) for name in HIDDEN}


class Reader:
    """Blocks of one page: (text, whether it stands in the article)."""

    def __init__(self, html: str):
        self.html = html
        self.blocks: list[tuple[str, bool]] = []
        self.parts: list[str] = []
        # open regions: [element, kind, how many elements of a name are open inside, and the first place of a region
        # that the start and the end of an item reach from here]
        self.regions: list[list] = []
        self.places: dict[str, list[int]] = {}  # of the open regions of an element
        self.outside: dict[str, int] = {}  # open lists outside of all regions
        self.levels: dict[str, list[int]] = {name: [] for name in LISTS}  # numbers of regions around open lists
        self.skips = self.articles = self.forms = 0
        self.has_article = self.has_main = False
        self.several = 0  # articles that stand in no other
        self.unended: set[str] = set()
        self._read()

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.blocks.append((text, self.articles > 0))

    def _text(self, start: int, end: int) -> None:
        if end > start and not self.skips and (self.articles or not self.forms):
            text = self.html[start:end]
            self.parts.append(unescape(text) if "&" in text else text)

    def _read(self) -> None:
        html, at, quotes = self.html, 0, True
        while True:
            sign = html.find("<", at)
            if sign < 0:
                self._text(at, len(html))
                break
            name = _NAME.match(html, sign + 1)
            if not name:
                mark = html[sign + 1 : sign + 2]
                if mark not in ("!", "?", "/"):
                    self._text(at, sign + 1)  # a bare sign is text
                    at = sign + 1
                    continue
                self._text(at, sign)
                comment = html.startswith("<!--", sign)
                end = html.find("-->" if comment else ">", sign + (4 if comment else 1))
                if end < 0:
                    break
                at = end + (3 if comment else 1)
                continue
            self._text(at, sign)
            rest = _REST.match(html, name.end()) if quotes else None
            if rest:
                end = rest.end()
            else:
                quotes = False  # quotes do not pair up from here on
                end = html.find(">", name.end()) + 1
                if not end:
                    break
            element = name.group(1).lower()
            if html[sign + 1] == "/":
                self._close(element)
            elif element in RAW:
                close = _CLOSE[element].search(html, end)
                if not close:
                    break
                end = html.find(">", close.end()) + 1
                if not end:
                    break
            elif element in HIDDEN:
                if not (element in FOREIGN and html.endswith("/>", sign, end)):
                    end = self._end_of(element, end)
            else:
                self._open(element, html[name.end() : end])
            at = end
        self._flush()

    def _end_of(self, element: str, start: int) -> int:
        """Where an element that is left out ends, with those of its name inside; one without an end leaves nothing out."""
        if element in self.unended:
            return start
        depth = 1
        for tag in _NESTED[element].finditer(self.html, start):
            if tag.group(1):
                depth -= 1
            elif not (element in FOREIGN and tag.group().endswith("/>")):
                depth += 1
            if not depth:
                return tag.end()
        self.unended.add(element)  # nor do those that follow, as every end is inside this one
        return start

    def _open(self, element: str, attributes: str) -> None:
        if element in BLOCKS:
            self._flush()
        if element in VOID and element not in OPTIONAL or attributes.endswith("/>") and element not in BLOCKS:
            return
        if element in OPTIONAL:
            self._close_open(element)
        if element in VOID:
            return
        kind = self._kind(element, attributes)
        if kind:
            self._flush()
            place = len(self.regions)
            reach = [place + 1 if element in held else self._reach(held) for held in (BETWEEN, LISTS)]
            self.regions.append([element, kind, {}, *reach])
            self.places.setdefault(element, []).append(place)
            self.skips += kind == "skip"
            self.articles += kind == "article"
            self.forms += kind == "form"
            if kind == "article" and not self.skips:
                self.has_article = True
                self.has_main |= element != "article"
                self.several += self.articles == 1
        elif element in LISTS or (
            self.regions and (element in BETWEEN or self.regions[-1][0] == element and element not in ENDS)
        ):
            inside = self.regions[-1][2] if self.regions else self.outside
            if element in LISTS and element not in inside:
                self.levels[element].append(len(self.regions))
            inside[element] = inside.get(element, 0) + 1

    def _close_open(self, element: str) -> None:
        """End the region of an item that was left open where the next one starts."""
        place = max((self.places[name][-1] for name in OPTIONAL[element] if self.places.get(name)), default=-1)
        if place >= 0 and place >= self._reach(BETWEEN):
            self._cut(place)

    def _reach(self, held: frozenset[str]) -> int:
        """The first place of a region that is not shut off by an open element of these."""
        if not self.regions:
            return 0
        top = self.regions[-1]
        if any(name in held for name in top[2]):
            return len(self.regions)
        return top[3 if held is BETWEEN else 4]

    def _kind(self, element: str, attributes: str) -> str | None:
        found: set[str] = set()
        role = ""
        strict = self.articles > 0 or element in ("article", "main")
        if "=" in attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                value = "".join(values).lower()
                if name.lower() == "role":
                    role = value.strip()
                else:
                    for own in value.split():
                        parts = [part for part in _SPLIT.split(own) if part]
                        if not parts or parts[0] in STATE_WORDS:
                            continue
                        # an article's own sections may be called "copyright-law" or "search-results"
                        if strict and not all(part in SKIPPED_WORDS or part in PLAIN_WORDS for part in parts):
                            continue
                        found.update(parts)
        if element in ("html", "body"):
            return None
        if element in ("article", "main") or role in ("main", "article"):
            return "skip" if found & COMMENT_WORDS else "article"
        if element == "form" and not self.articles:
            return "form"  # some pages wrap all they have in one form, the article too
        if element in SKIPPED or role in SKIPPED_ROLES or found & SKIPPED_WORDS:
            return "skip"
        if not self.articles and (element == "header" or "header" in found or "masthead" in found):
            return "skip"
        return None

    def _close(self, element: str) -> None:
        if element in BLOCKS:
            self._flush()
        place = self.places[element][-1] if self.places.get(element) else -1
        if element in LISTS and self.levels[element] and self.levels[element][-1] > place:
            self._cut(self.levels[element][-1])  # what was left open in a list ends with it
        inside = self.regions[-1][2] if self.regions else self.outside
        if element in inside:
            inside[element] -= 1
            if not inside[element]:
                del inside[element]
                if element in LISTS:
                    self.levels[element].pop()
        elif place >= 0 and (element not in ENDS or place >= self._reach(LISTS)):
            self._cut(place)

    def _cut(self, place: int) -> None:
        """Close a region with all that are open inside."""
        if len(self.regions) > place:
            self._flush()
        while len(self.regions) > place:
            element, kind, inside, *_ = self.regions.pop()
            self.places[element].pop()
            for name in LISTS.intersection(inside):
                self.levels[name].pop()
            self.skips -= kind == "skip"
            self.articles -= kind == "article"
            self.forms -= kind == "form"


def read_page(html: str) -> tuple[str | None, list[str]]:
    """The text of a marked article, or None and the blocks that may belong to the text."""
    page = Reader(html)
    if page.has_article:
        sizes = [0, 0]
        for text, inside in page.blocks:
            sizes[inside] += len(text)
        teasers = page.several > 1 and not page.has_main and sizes[0] > sizes[1]
        if not teasers:
            return " ".join(text for text, inside in page.blocks if inside), []
    return None, [text for text, _ in page.blocks]


def parsed(html: str | Column) -> Column:
    """``text`` of a marked article, else ``loose`` blocks."""

    @F.arrow_udf("struct<text: string, loose: array<string>>")
    def run(column: pa.Array) -> pa.Array:
        pages = [read_page(page or "") for page in column.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([t for t, _ in pages], pa.string()), pa.array([b for _, b in pages], pa.list_(pa.string()))],
            ["text", "loose"],
        )

    return run.asNondeterministic()(html)


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Start places of all suffixes in order, by doubling the sorted length."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while True:
        behind = np.full(n, -1, np.int64)
        behind[: n - reach] = rank[reach:] if reach < n else []
        order = np.lexsort((behind, rank))
        changes = (np.diff(rank[order]) != 0) | (np.diff(behind[order]) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(changes)])
        if n < 2 or rank[order[-1]] == n - 1:
            return order
        reach *= 2


def stretches(codes: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Start places in suffix order, and the number of the class of places that share their first tokens.

    Places with fewer tokens behind them are classes of their own.
    """
    n = len(codes)
    order = suffix_array(codes)
    same = np.ones(max(0, n - 1), bool)  # neighbours are compared a token at a time
    for step in range(reach):
        left, right = order[:-1] + step, order[1:] + step
        inside = (left < n) & (right < n)
        same &= inside & (codes[np.minimum(left, n - 1)] == codes[np.minimum(right, n - 1)])
    return order, np.concatenate([[0], np.cumsum(~same)]).astype(np.int64)


def stream(blocks: list[str]) -> list[str]:
    """The words of a page with a mark before, between and behind its blocks."""
    tokens = [MARK]
    for block in blocks:
        tokens += block.split(" ")
        tokens.append(MARK)
    return tokens


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ values >> np.uint64(31)
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ values >> np.uint64(29)


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    sums = np.zeros(len(codes) - size + 1, np.uint64)
    for step in range(size):
        sums = _mixed(sums * np.uint64(0x9E3779B97F4A7C15) + codes[step : step + len(sums)])
    return sums


def pieces(tokens: list[str]) -> Iterator[tuple[int, int, int, bool]]:
    """(anchor, first token, end, fresh) of the stretches that choose one anchor.

    Fresh ones hold stretches that stand nowhere before on the page, the others only such that do:
    a page counts once for a stretch.
    """
    if len(tokens) < REACH:
        return
    codes = np.array([xxhash.xxh3_64_intdigest(token) for token in tokens], np.uint64)
    grams = _grams(codes, GRAM)
    chosen = np.lib.stride_tricks.sliding_window_view(grams, REACH - GRAM + 1).argmin(1)
    chosen += np.arange(len(chosen))
    fresh = np.zeros(len(chosen), bool)
    fresh[np.unique(_grams(codes, REACH), return_index=True)[1]] = True
    cuts = np.flatnonzero((np.diff(chosen) != 0) | (fresh[1:] != fresh[:-1])) + 1
    firsts = np.concatenate([[0], cuts])
    ends = np.concatenate([cuts, [len(chosen)]]) + REACH - 1
    yield from zip(grams[chosen[firsts]].view(np.int64).tolist(), firsts.tolist(), ends.tolist(), fresh[firsts].tolist())


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


PIECES = "host string, page string, key long, piece binary, at long, fresh long, tokens string"
COMMON = "host string, key long, piece binary, step long, k long, c long"


def _pieces(distinct: DataFrame) -> DataFrame:
    """The pieces of distinct pages (host, page, loose)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, page, blocks in zip(*(batch.column(name).to_pylist() for name in ("host", "page", "loose"))):
                tokens = stream(blocks)
                rows = []
                for key, first, end, fresh in pieces(tokens):
                    text = " ".join(tokens[first:end])
                    rows.append((host, page, key, _digest(text), first, int(fresh), text))
                    if len(rows) == 50_000:
                        yield _batch(rows, PIECES)
                        rows = []
                if rows:
                    yield _batch(rows, PIECES)

    return distinct.select("host", "page", "loose").mapInArrow(run, PIECES)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [field.split() for field in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(column), kinds[kind]) for column, (_, kind) in zip(columns, fields)], [name for name, _ in fields]
    )


def common_stretches(pool: list[tuple], least_pages: int) -> list[tuple]:
    """Rows of ``COMMON`` for pieces (host, key, piece, pages, tokens) of whole anchors, by one suffix array."""
    codes: list[int] = []
    names: dict[tuple, int] = {}
    owner: list[int] = []
    step: list[int] = []
    for number, (host, key, _, _, text) in enumerate(pool):
        tokens = text.split(" ")
        # anchors and hosts never meet, so their tokens differ
        codes += [names.setdefault((host, key, token), len(names)) for token in tokens]
        codes.append(-1 - number)
        owner += [number] * (len(tokens) - REACH + 1) + [-1] * REACH
        step += range(len(tokens) + 1)
    order, numbers = stretches(np.array(codes, np.int64), REACH)
    owners, steps = np.array(owner)[order], np.array(step)[order]
    whole = owners >= 0
    owners, steps, numbers = owners[whole], steps[whole], numbers[whole]
    pages = np.bincount(numbers, np.array([row[3] for row in pool], np.float64)[owners])
    rows = []
    for which, at, number in zip(owners.tolist(), steps.tolist(), numbers.tolist()):
        if pages[number] >= least_pages:
            host, key, piece, *_ = pool[which]
            rows.append((host, key, piece, at, key, number))
    return rows


def _sorted(counted: DataFrame, least_pages: int) -> DataFrame:
    """The common stretches of pieces (host, key, piece, n, tokens); a task holds one pool at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in ("host", "key", "piece", "n", "tokens"))):
                if held >= POOL_TOKENS and row[:2] != last:
                    yield _batch(common_stretches(pool, least_pages), COMMON)
                    pool, held = [], 0
                pool.append(row)
                held += row[4].count(" ") + 2
                last = row[:2]
        if pool:
            yield _batch(common_stretches(pool, least_pages), COMMON)

    dealt = counted.select("host", "key", "piece", "n", "tokens").repartition("host", "key")
    return dealt.sortWithinPartitions("host", "key").mapInArrow(run, COMMON)


def _singles(counted: DataFrame, least_pages: int) -> DataFrame:
    """The same for anchors with pieces without number: every stretch is a key of its own, told by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, key, piece, n, text in zip(*(batch.column(x).to_pylist() for x in ("host", "key", "piece", "n", "tokens"))):
                tokens = text.split(" ")
                for at in range(len(tokens) - REACH + 1):
                    name = _digest(" ".join(tokens[at : at + REACH]))
                    k, c = (int.from_bytes(half, "little", signed=True) for half in (name[:8], name[8:]))
                    rows.append((host, key, piece, at, k, c if c < 0 else ~c, n))
            yield _batch(rows, f"{COMMON}, n long")

    each = counted.select("host", "key", "piece", "n", "tokens").mapInArrow(run, f"{COMMON}, n long")
    often = each.groupBy("host", "k", "c").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_pages)
    return each.drop("n").join(often.drop("n"), ["host", "k", "c"]).select("host", "key", "piece", "step", "k", "c")


def cover(places: list[int], size: int) -> np.ndarray:
    """Which of so many tokens the stretches that start at these places cover."""
    edges = np.zeros(size + 1, np.int64)
    starts = np.array(places, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + REACH, size), -1)
    return np.cumsum(edges[:-1]) > 0


def kept_words(blocks: list[str], gone: list[tuple[int, bool]], least_words: int, long_run: int) -> np.ndarray:
    """Which tokens of the page's stream stay; ``gone`` holds (place, whether many pages of the host hold it)."""
    tokens = stream(blocks)
    marks = np.array([token == MARK for token in tokens])
    stays = ~marks
    if not gone:
        return stays
    found = cover([place for place, _ in gone], len(tokens))
    at = np.flatnonzero(marks)
    run: list[int] = []
    for number in range(len(blocks) + 1):
        if number < len(blocks) and found[at[number] : at[number + 1] + 1].all():
            run.append(number)
            continue
        if run and at[run[-1] + 1] - at[run[0]] - len(run) >= least_words:
            stays[at[run[0]] : at[run[-1] + 1]] = False
        run = []
    often = cover([place for place, many in gone if many], len(tokens))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], often.astype(np.int8), [0]])))
    for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if (~marks[first:end]).sum() >= long_run:
            stays[first:end] = False
    return stays


def _own(blocks: list[str], repeated: list[int], stays: np.ndarray) -> tuple[bytes | None, int]:
    """A signature of a page's own words, equal for most near copies, and their share of the page in eighths.

    The signature is the least digest of three words in a row: two texts agree on it as often as their triples do.
    """
    tokens = stream(blocks)
    own = np.flatnonzero(stays & ~cover(repeated, len(tokens))).tolist()
    if not own:
        return None, 0
    words = [tokens[at] for at in own]
    least = min(_digest(" ".join(words[at : at + 3])) for at in range(max(1, len(words) - 2)))
    return least, 8 * len(words) // int(stays.sum())


GONE = "array<struct<at: long, many: boolean>>"


def _places(column: pa.Array) -> list[list[tuple[int, bool]]]:
    return [[(mark["at"], mark["many"]) for mark in marks or ()] for marks in column.to_pylist()]


def _boilerplate(open_pages: DataFrame, least_words: int, least_pages: int, long_run: int, least_share: float, key_pieces: int) -> DataFrame:
    """(host, page, gone): the places of the stretches that go, for pages (host, page, loose) that hold any.

    Shuffled are the pieces of distinct pages, equal ones combined in each task first.
    """

    @F.arrow_udf("struct<own: binary, share: long>")
    def owns(loose: pa.Array, repeated: pa.Array, gone: pa.Array) -> pa.Array:
        columns = loose.to_pylist(), repeated.to_pylist(), _places(gone)
        rows = [_own(blocks, places, kept_words(blocks, g, least_words, long_run)) for blocks, places, g in zip(*columns)]
        return pa.StructArray.from_arrays(
            [pa.array([own for own, _ in rows], pa.binary()), pa.array([share for _, share in rows], pa.int64())],
            ["own", "share"],
        )

    name = ["host", "key", "piece"]
    distinct = written(open_pages.select("host", "page", "loose").dropDuplicates(["host", "page"]), "distinct")
    every = written(_pieces(distinct), "pieces")
    counted = every.groupBy(name).agg(F.sum("fresh").alias("n"), F.first("tokens").alias("tokens"))
    counted = written(counted, "counted")
    often = counted.groupBy("host", "key").agg(F.sum("n").alias("pages"), F.count("*").alias("kinds"))
    often = often.filter(F.col("pages") >= least_pages)
    few = counted.join(often.filter(F.col("kinds") <= key_pieces).select("host", "key"), ["host", "key"])
    many = counted.join(often.filter(F.col("kinds") > key_pieces).select("host", "key"), ["host", "key"])
    common = written(_sorted(few, least_pages).unionByName(_singles(many, least_pages)), "common")
    # the pieces of pages that hold a common stretch, without their tokens
    steps = common.groupBy(name).agg(F.collect_list("step").alias("steps"))
    held = written(every.drop("tokens").join(steps, name), "held")
    places = F.transform("steps", lambda step: step + F.col("at"))
    repeated = held.groupBy("host", "page").agg(F.flatten(F.collect_list(places)).alias("repeated"))
    marked = written(distinct.join(repeated, ["host", "page"]), "marked")
    silent = distinct.join(repeated, ["host", "page"], "left_anti")  # nothing of these pages repeats
    silent = silent.groupBy("host").agg(F.count("*").alias("silent"))
    gone = marked.limit(0).select("host", "page", F.lit(None).cast(GONE).alias("gone"))
    for _ in range(2):
        told = marked.join(gone, ["host", "page"], "left")
        told = told.select("host", "page", owns.asNondeterministic()("loose", "repeated", "gone").alias("o"))
        told = written(told.select("host", "page", "o.own", "o.share").filter("own is not null and share >= 1"), "own")
        mostly = F.col("share") >= 4
        alike = told.groupBy("host", "own").agg(F.count("*").alias("partly"), F.count(F.when(mostly, 1)).alias("mostly"))
        # pages with the same own words share a vote, so votes of pieces add up
        votes = told.join(alike, ["host", "own"]).select(
            "host",
            "page",
            F.expr(f"{VOTE} div partly").alias("partly"),
            F.when(mostly, F.expr(f"{VOTE} div mostly")).otherwise(F.lit(0)).alias("mostly"),
            F.when(mostly, 1).otherwise(0).alias("most"),
        )
        cast = held.filter("fresh = 1").join(votes, ["host", "page"]).groupBy(name).agg(
            F.sum("partly").alias("partly"), F.sum("mostly").alias("mostly"), F.sum("most").alias("most"), F.count("*").alias("n")
        )
        total = alike.groupBy("host").agg(F.count("*").alias("voices")).join(silent, "host", "left")
        total = total.select("host", (F.col("voices") + F.coalesce("silent", F.lit(0))).alias("voices"))
        summed = common.join(cast, name).groupBy("host", "k", "c").agg(
            *(F.sum(column).alias(column) for column in ("partly", "mostly", "most", "n"))
        )

        def enough(votes: str, pages: str, least: int) -> Column:
            # a vote that is shared loses less than one unit a page; near copies have a vote for four pages at most
            return (F.col(votes) + F.col(pages) >= least * VOTE) & (4 * (F.col(votes) + F.col(pages)) >= F.col(pages) * VOTE)

        going = summed.filter(
            enough("mostly", "most", least_pages) | enough("partly", "n", max(least_pages, MANY_PAGES))
        ).join(total, "host")
        going = going.select(
            "host", "k", "c", (F.col("partly") + F.col("n") >= F.col("voices") * F.lit(least_share) * VOTE).alias("many")
        )
        marks = common.join(going, ["host", "k", "c"]).groupBy(name).agg(
            F.collect_list(F.struct(F.col("step"), F.col("many"))).alias("marks")
        )
        moved = F.transform("marks", lambda mark: F.struct((mark["step"] + F.col("at")).alias("at"), mark["many"].alias("many")))
        found = held.join(marks, name).groupBy("host", "page").agg(F.flatten(F.collect_list(moved)).alias("gone"))
        gone = written(found, "gone")
    return gone


def extract(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_words: int = LEAST_WORDS,
    least_pages: int = LEAST_PAGES,
    long_run: int = LONG_RUN,
    least_share: float = LEAST_SHARE,
    key_pieces: int = KEY_PIECES,
) -> DataFrame:
    """One row per page: its id, url, main text and the text's length in code points.

    ``key_pieces`` chooses how stretches are sorted, never what is found.
    """
    if least_words < REACH - 2:
        raise ValueError(f"runs of {REACH - 2} words and more can be found")
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), parsed(F.col(html)).alias("p"))
    read = written(named.select("page_id", "url", "p.text", "p.loose"), "pages")
    settled = read.filter("text is not null").select("page_id", "url", "text")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    page = F.sha2(F.array_join("loose", "\n"), 256)
    open_pages = read.filter("text is null").select("page_id", "url", "loose", host.alias("host"), page.alias("page"))
    gone = _boilerplate(open_pages, least_words, least_pages, long_run, least_share, key_pieces)

    @F.arrow_udf("string")
    def left(loose: pa.Array, gone: pa.Array) -> pa.Array:
        texts = []
        for blocks, places in zip(loose.to_pylist(), _places(gone)):
            stays = kept_words(blocks, places, least_words, long_run)
            texts.append(" ".join(token for token, stay in zip(stream(blocks), stays.tolist()) if stay))
        return pa.array(texts, pa.string())

    mended = open_pages.join(gone, ["host", "page"], "left").select(
        "page_id", "url", left.asNondeterministic()("loose", "gone").alias("text")
    )
    every = settled.unionByName(mended)
    return every.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
