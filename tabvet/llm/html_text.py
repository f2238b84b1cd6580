"""HTML main-text extraction by two-pass block rules.

The page is cut into tags and text by one scan. Text of a block-level element is one block; what lies in scripts,
styles, forms and other non-text elements is no text. Each block knows its length, its share of stop words, its share
of characters inside links, and the structure it stands in.

Pass 1 (context-free) calls a block boilerplate when it stands in a menu, header, footer, sidebar, notice, advert or
comment element (by element name, role, the attribute hidden, or words of its class and id), or when its link density
is high. Headings in an article's own header stay. Words of class and id, and forms, do not count above an article or main element, nor where the element so named holds most
of the page's long text rich in stop words: there the block's own text decides. Otherwise a block is good when it
is long enough and rich in stop words, or long and free of links inside the article element; near-good or short
otherwise.
Pass 2 (context-sensitive): an undecided block inherits the label of its nearest decided neighbours: good when both
sides are good, when the nearer one is good, or, at equal distance, when it stands in the article element or is a
heading before a good block. With no decided neighbour at all, blocks in the article, or else in the body, are good.

Stop words are not given: a word counts as one when it is among the most frequent short words of the page's own text
or of the small fixed lists below.

Defined results: null and empty html give an empty text; broken markup (unclosed or stray tags, open quotes, a file
that ends inside a tag, comment or script) is read as far as it goes, in linear time; pages of any length are read whole; repeated rows give
repeated results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.llm.common import read

#: Frequent function words of some languages: a start for the stop-word share, completed by the page's own words.
STOP_WORDS = frozenset(
    "the of and to in a is it for that on with as are be at this by from or was not "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine im dem "
    "le la les de des et un une du en est que pour qui dans par sur au avec pas plus "
    "el los las y del que por con una para se su al lo como es".split()
)
RAW = frozenset("script style noscript template textarea svg math iframe object canvas select title".split())
RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
OPENING = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?]|/(?![a-z]))|(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*+))", re.I)
UNQUOTED = re.compile(r"[^>\"']*+")
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AUTO_CLOSED = frozenset("p li td th tr dd dt option".split())
BAD_ELEMENTS = frozenset("nav footer header aside menu dialog button fieldset label head".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
BAD_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|"
    r"subscribe|signup|login|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|widget|related|recommended|share|sharing|social|"
    r"footer|header|masthead|comments?|disqus|replies|pagination|pager|toolbar|copyright)(?:$|[\s_-])",
    re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|["'][^"']*["']?|.""", re.S)
WORD = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s+")
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPS_LOW, STOPS_HIGH = 0.15, 0.30
LINKS_HIGH = 0.33
GOOD, BAD, OPEN = 1, -1, 0


NO, WORDS, SURE = 0, 1, 2  # what a mark as boilerplate rests on
HEADER = 3  # inside the header of an article: boilerplate but for its headings
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def mark(name: str, rest: str) -> int:
    """SURE for elements, roles and hidden ones, WORDS for forms and words of class and id, which may wrap whole pages."""
    if name in BAD_ELEMENTS:
        return SURE
    if not rest or name in ("html", "body"):
        return WORDS if name == "form" else NO
    found, seen = (WORDS if name == "form" else NO), set()
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").strip()
        if not key or key in seen:  # of repeated attributes the first counts
            continue
        seen.add(key)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return SURE
        if name in ("article", "main"):
            continue
        if key == "role" and value.lower() in BAD_ROLES:
            return SURE
        if key in ("class", "id") and BAD_WORDS.search(value):
            found = WORDS
    return found


def tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, stop, closes, name, attributes) of every tag; comments, declarations and raw elements have no name.

    The scan only goes forward: a tag ends at the first > outside quotes, a quote that nothing closes counts as a plain
    character, and what never ends reaches to the end of the page."""
    at, size = 0, len(page)
    closed = {'"': True, "'": True}  # whether this quote may still occur

    def tag_end(i: int) -> int:
        """Where the > of the tag stands whose name ends at i, or -1."""
        while True:
            i = UNQUOTED.match(page, i).end()
            if i == size:
                return -1
            sign = page[i]
            if sign == ">":
                return i
            j = page.find(sign, i + 1) if closed[sign] else -1
            closed[sign] = j >= 0
            i = j + 1 if j >= 0 else i + 1

    while m := OPENING.search(page, at):
        start = m.start()
        if m["comment"]:
            j = page.find("-->", m.end())
            at = j + 3 if j >= 0 else size
            yield start, at, False, "", ""
            continue
        if m["other"]:
            j = page.find(">", m.end())
            at = j + 1 if j >= 0 else size
            yield start, at, False, "", ""
            continue
        name, stop = m["name"].lower(), tag_end(m.end())
        if stop < 0:
            yield start, size, False, "", ""
            return
        rest = page[m.end() : stop]
        at = stop + 1
        if name in RAW and not m["close"]:
            if not (name in ("svg", "math") and rest.endswith("/")):
                end = RAW_END[name].search(page, at)
                at = end.end() if end else size
            name = ""
        yield start, at, bool(m["close"]), name, rest


class Wrapper:
    """An element with a boilerplate word in its class or id, or an article or main element that takes back such words."""

    __slots__ = ("above", "articles", "at", "bad", "resets", "rich")

    def __init__(self, above: Wrapper | None, at: int, resets: bool):
        self.above, self.at, self.resets, self.rich, self.articles, self.bad = above, at, resets, 0, 0, False


class Block:
    __slots__ = ("article", "bad", "heading", "links", "text", "wrapped")

    def __init__(self, text: str, links: int, bad: bool, article: bool, heading: bool, wrapped: Wrapper | None):
        self.text, self.links, self.bad, self.article, self.heading, self.wrapped = text, links, bad, article, heading, wrapped


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in page order."""
    found: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int, bool, Wrapper | None]] = []  # name, NO, SURE or HEADER, article and wrapper up to here
    top = ("", NO, False, None)
    open_ = Counter()  # how often each name is on the stack

    def leave() -> str:
        name = stack.pop()[0]
        open_[name] -= 1
        return name

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", "".join(t for t, _ in parts)).strip()
            if text:
                links = sum(len(t) for t, linked in parts if linked)
                _, bad, article, wrapped = stack[-1] if stack else top
                found.append(Block(text, links, bad != NO, article, any(e[0] in HEADINGS for e in stack[-3:]), wrapped))
            parts.clear()

    def add(text: str) -> None:
        if text:
            parts.append((html.unescape(text) if "&" in text else text, open_["a"] > 0))

    at = 0
    for start, stop, closes, name, rest in tokens(page):
        add(page[at:start])
        at = stop
        if not name:
            continue
        if name in BLOCKS:
            flush()
        if closes:
            if open_[name] > 0:  # closes what stands open inside it, too
                while leave() != name:
                    pass
        elif name not in VOID and not rest.rstrip().endswith("/"):
            if name in AUTO_CLOSED and stack and stack[-1][0] == name:
                leave()
            elif name == "p" or name in BLOCKS:
                while stack and stack[-1][0] not in BLOCKS:  # inline elements do not reach into the next block
                    leave()
                if name != "p" and stack and stack[-1][0] == "p" or name == "p" and stack and stack[-1][0] == "p":
                    leave()
            _, bad, article, wrapped = stack[-1] if stack else top
            open_[name] += 1
            own, resets = mark(name, rest), name in ("article", "main")
            if own == WORDS or resets and wrapped:
                wrapped = Wrapper(wrapped, start, resets)
            if own == SURE and not (bad == NO and article and name == "header"):
                bad = SURE
            elif own == SURE:
                bad = HEADER
            elif bad == HEADER and name in HEADINGS:
                bad = NO
            stack.append((name, bad, article or resets, wrapped))
    add(page[at:])
    flush()
    return found


def stop_words(page: list[Block], words: list[list[str]]) -> frozenset[str]:
    common = Counter(w for b, some in zip(page, words) if not b.bad for w in some if len(w) <= 4)
    total = sum(map(len, words))
    return STOP_WORDS | {w for w, n in common.items() if n >= max(3, total / 200)}


def judge_wrappers(page: list[Block], words: list[list[str]]) -> None:
    """Blocks inside an element with a boilerplate word become boilerplate, unless it wraps the page's content.

    It does when it holds more than half of the text of all long blocks rich in stop words, and some of those in article
    or main elements if there are such."""
    stops = stop_words(page, words)
    every: dict[int, Wrapper] = {}
    rich = articles = 0
    for b, some in zip(page, words):
        w = b.wrapped
        while w and w.at not in every:
            every[w.at] = w
            w = w.above
        share = sum(x in stops for x in some) / len(some) if some else 0.0
        size = len(b.text)
        if b.bad or size < LENGTH_LOW or b.links / size > LINKS_HIGH or share < (STOPS_LOW if size >= LENGTH_HIGH else STOPS_HIGH):
            continue
        rich, articles = rich + size, articles + size * b.article
        if b.wrapped:
            b.wrapped.rich += size
            b.wrapped.articles += size * b.article
    for at in sorted(every, reverse=True):  # inner ones first
        w = every[at]
        if w.above:
            w.above.rich += w.rich
            w.above.articles += w.articles
    for at in sorted(every):
        w = every[at]
        holds = 2 * w.rich > rich and (w.articles > 0 or not articles)
        w.bad = not w.resets and (not holds or bool(w.above and w.above.bad))
    for b in page:
        b.bad = b.bad or bool(b.wrapped and b.wrapped.bad)


def labels(page: list[Block]) -> list[int]:
    """GOOD or BAD for each block."""
    words = [[w.lower() for w in WORD.findall(b.text)] for b in page]
    if any(b.wrapped for b in page):
        judge_wrappers(page, words)
    stops = stop_words(page, words)
    first = []
    for b, some in zip(page, words):
        share = sum(w in stops for w in some) / len(some) if some else 0.0
        density = b.links / len(b.text)
        if b.bad or density > LINKS_HIGH:
            label = BAD
        elif len(b.text) < LENGTH_LOW:
            label = OPEN  # short
        elif share >= STOPS_HIGH or share >= STOPS_LOW and len(b.text) >= LENGTH_HIGH or b.article and not b.links:
            label = GOOD
        else:
            label = OPEN  # near-good
        first.append(label)
    if GOOD not in first:
        inside = any(b.article for b, x in zip(page, first) if x == OPEN)
        return [GOOD if x == OPEN and (b.article or not inside) else BAD for b, x in zip(page, first)]
    before, after, last = [None] * len(page), [None] * len(page), None
    for i, x in enumerate(first):
        before[i] = last
        last = i if x != OPEN else last
    last = None
    for i in reversed(range(len(page))):
        after[i] = last
        last = i if first[i] != OPEN else last
    out = []
    for i, (b, x) in enumerate(zip(page, first)):
        if x == OPEN:
            near = [j for j in (before[i], after[i]) if j is not None]
            votes = {first[j] for j in near}
            if len(votes) == 1:
                x = votes.pop()
            elif b.article or b.heading and after[i] is not None and first[after[i]] == GOOD:
                x = GOOD  # the boilerplate side is another element
            else:
                left, right = i - before[i], after[i] - i
                x = first[before[i]] if left < right else first[after[i]] if right < left else BAD
            if x == BAD and b.article and not b.links:
                x = GOOD
        out.append(x)
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, x in zip(found, labels(found)) if x == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
