"""Main text of web pages by two passes of block rules.

Pass 1 cuts a page into blocks at block-level tags and judges each on its own by density
of links, length and density of stop words: blocks that are mostly links are bad, long
ones rich in stop words good, and the others stay undecided (short, medium, long and poor
in stop words, or a single short link).  If no block of a page is rich in stop words, as
in languages that the lists lack, length takes the place of their density.

Pass 2 gives undecided blocks the label of their nearest decided neighbours.  A neighbour
counts first that is of the same kind (same tag below the same element), so paragraphs
beside a good paragraph are good whatever stands between; then the nearest on either side,
the page's edges being bad.  A heading goes with what it heads.  If nothing on a page is
good by itself, the kind of undecided blocks with most text is.

Marks are evidence on the one block that carries or stands inside them, never a rule for
the page: inside nav, aside, footer and the like, or an element all of whose name says
advert, comments, menu and so on, a block is bad; inside a form or a page's header only
blocks that pass 1 finds good stay; inside article or main a good neighbour on one side
is enough.  Without any marks the densities decide alone (see ``share_of_reasons``).

The scan is linear in the page: each position is passed a bounded number of times,
whatever quotes and elements are left open.

Results: null and empty pages have an empty text, an empty table no rows; unclosed tags
end with their parent, an unclosed script or comment with the page; every row keeps its
own result, columns beyond the three named ones are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

# Element names of HTML.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text of these is never markup; one left open ends with the page.
RAW_TAGS = frozenset("script style xmp noembed noframes".split())
#: Their inside is no text of the page; one left open hides nothing.
CONTROL_TAGS = frozenset("noscript template textarea iframe svg math object select button canvas audio video".split())
BAD_TAGS = frozenset("nav aside footer head menu dialog title".split())
SOFT_TAGS = frozenset("form header".split())
MAIN_TAGS = frozenset("article main".split())
#: Open elements that an opening tag closes, besides p, which every block closes.
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Words that name parts of a page which are not its article ...
BAD_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist respond disqus consent cookie cookies footer gdpr masthead menu modal nav navbar navigation newsletter notice notices alert pager pagination paywall popup promo promoted promotion recommended related share sharing sidebar social sponsor sponsored sponsors subscribe toolbar topbar widget contentinfo complementary".split())
#: ... and words that may stand beside them in a name without changing what it says.
NEUTRAL_NAMES = frozenset("a the and of for by top bottom left right inner outer first last box boxes bar bars list lists item items block blocks wrap wrapper container row col column cell area panel section unit slot group site page global primary secondary link links button buttons icon icons post posts article articles story stories reader readers user users form text body title head heading content header policy message text".split())
MAIN_WHOLE = frozenset("content main main-content maincontent article-body articlebody post-content post-body entry-content article-content story-body page-content".split())
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or our she that the their there they this to was we were what which who will with you your "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas pour qui que sa se ses son sur un une vous "
    "als am auch auf aus bei das dem den der des die ein eine einer es für hat im in ist mit nach nicht noch sich sie sind so und von war wie wir zu zum zur "
    "al como con de del el ella en es esta este la las lo los más no o para pero por que se ser si sin sobre su sus un una y".split()
)

_OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_QUOTE_OR_END = re.compile(r"[>\"']")
_NEXT_OF = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in RAW_TAGS | CONTROL_TAGS}
_WORD = re.compile(r"[^\W\d_]+")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Block(NamedTuple):
    text: str
    in_links: int  # characters inside links
    place: str  # bad, soft, main or nothing
    heading: bool
    kind: tuple  # its tag and the element that this stands in


def _tag_end(page: str, at: int) -> tuple[int, int]:
    """Where a tag's attributes end and what follows it begins; a quote left open ends at the next bracket."""
    while True:
        m = _QUOTE_OR_END.search(page, at)
        if m is None:
            return len(page), len(page)
        if m[0] == ">":
            return m.start(), m.end()
        close = page.find(m[0], m.end())
        if close < 0:
            end = page.find(">", m.end())
            return (end, end + 1) if end >= 0 else (len(page), len(page))
        at = close + 1


def _says_bad(name: str) -> bool:
    """Whether all of a class or id names a part that is no article: each of its words does or is neutral."""
    words = [w.lower() for w in _NAME_PART.findall(name)]
    return any(w in BAD_NAMES for w in words) and all(w in BAD_NAMES or w in NEUTRAL_NAMES or w.isdigit() for w in words)


def _place(tag: str, attributes: str) -> str:
    """What an element says of its inside."""
    if tag in BAD_TAGS:
        return "bad"
    if attributes:
        if _HIDDEN.search(attributes):
            return "bad"
        if tag not in ("html", "body"):
            for name, value in _ATTRIBUTE.findall(attributes):
                for one in value.strip("\"'").split():
                    if tag not in MAIN_TAGS and _says_bad(one):
                        return "bad"
                    if one.lower() in MAIN_WHOLE or name.lower() == "role" and one.lower() == "main":
                        return "main"
    return "main" if tag in MAIN_TAGS else "soft" if tag in SOFT_TAGS else ""


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order."""
    out: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, str, int]] = []  # tag, place, number of the element
    spots: dict[str, list[int]] = {}  # of each open tag, where it is on the stack
    blocks: list[int] = []  # where block-level tags are on the stack
    marks: list[str] = []  # what open elements say, the innermost last
    held = Counter()
    serial = 0

    def flush() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                in_links = len(" ".join(html.unescape("".join(linked)).split())) if linked else 0
                place = "bad" if held["bad"] else marks[-1] if marks else ""
                inner = stack[blocks[-1]] if blocks else ("", "", 0)
                outer = stack[blocks[-2]][2] if len(blocks) > 1 else 0
                out.append(Block(" ".join(words), in_links, place, held["heading"] > 0, (inner[0], outer)))
        text.clear()
        linked.clear()

    def shift(tag: str, place: str, by: int) -> None:
        held[place] += by
        if place and by > 0:
            marks.append(place)
        elif place:
            marks.pop()
        if tag == "a":
            held["a"] += by
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            held["heading"] += by

    def pop_to(k: int) -> None:
        while len(stack) > k:
            tag, place, _ = stack.pop()
            spots[tag].pop()
            if tag in BLOCK_TAGS:
                blocks.pop()
            shift(tag, place, -1)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text.append(page[at:lt])
            if held["a"]:
                linked.append(page[at:lt])
        if lt >= n:
            break
        m = _OPENING.match(page, lt)
        if m is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else n
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                at = end + 3 if end >= 0 else n
            elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
            else:
                text.append("<")
                at = lt + 1
            continue
        stop, at = _tag_end(page, m.end())
        attributes, tag = page[m.end() : stop], m[2].lower()
        if m[1]:
            where = spots.get(tag)
            if tag in BLOCK_TAGS:
                flush()
                if where:
                    pop_to(where[-1])
            elif where and (not blocks or where[-1] > blocks[-1]):  # an inline end tag does not close blocks
                pop_to(where[-1])
            continue
        if tag in _NEXT_OF and not attributes.endswith("/"):
            text.append(" ")
            nxt = _NEXT_OF[tag].search(page, at)
            while nxt is not None and not nxt[1] and tag in RAW_TAGS:
                nxt = _NEXT_OF[tag].search(page, nxt.end())
            if nxt is not None and nxt[1]:
                at = _tag_end(page, nxt.end())[1]
            elif tag in RAW_TAGS:
                at = n
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            while blocks and ((top := stack[blocks[-1]][0]) == "p" or tag in CLOSES.get(top, ())):
                pop_to(blocks[-1])
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS:
            continue
        place = "" if tag == "header" and held["main"] else _place(tag, attributes)
        serial += 1
        spots.setdefault(tag, []).append(len(stack))
        if tag in BLOCK_TAGS:
            blocks.append(len(stack))
        stack.append((tag, place, serial))
        shift(tag, place, 1)
    flush()
    return out


#: Tags of which two blocks below one element need not be of one kind.
ANY_KIND = frozenset(["", "body", "div", "section", "td", "th", "center"])
SHORT, LONG = 70, 200
LOW, HIGH = 0.08, 0.2


def first_pass(block: Block) -> str:
    """good, bad, or undecided: near (medium and rich in stop words), long (poor in them), weak (the same, medium), link (a single short link), short."""
    density, size = block.in_links / len(block.text), len(block.text)
    if density > 0.5:
        return "link" if size < SHORT else "bad"
    if size < SHORT:
        return "short"
    words = _WORD.findall(block.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if density > 0.25 and stop < HIGH:
        return "bad"
    if stop >= HIGH:
        return "good" if size > LONG else "near"
    return "near" if stop >= LOW else "long" if size > LONG else "weak"


def judge(blocks: list[Block]) -> list[tuple[bool, str]]:
    """Of each block, whether it belongs to the main text and what decided: place, density or neighbour."""
    n = len(blocks)
    label = [first_pass(b) for b in blocks]
    # links that follow one another are a menu
    label = ["bad" if x == "link" and ("link" in label[max(i - 1, 0) : i] or "link" in label[i + 1 : i + 2]) else x for i, x in enumerate(label)]
    if not any(x in ("good", "near") for x in label):  # no language of the lists
        label = [{"long": "good", "weak": "near"}.get(x, x) for x in label]
    why = ["density" if x in ("good", "bad") else "neighbour" for x in label]
    for i, b in enumerate(blocks):
        if label[i] != "bad" and (b.place == "bad" or b.place == "soft" and label[i] != "good"):
            label[i], why[i] = "bad", "place"

    if "good" not in label:  # nothing is long: the kind with most text is the main text
        size: Counter = Counter()
        for b, x in zip(blocks, label, strict=True):
            size[b.kind] += len(b.text) * (x not in ("bad", "link") and not b.heading)
        most = max(size, key=lambda k: size[k], default=None)
        label = ["good" if b.kind == most and x not in ("bad", "link") and not b.heading else x for b, x in zip(blocks, label, strict=True)]
        if "good" not in label:  # headings alone
            label = ["good" if x not in ("bad", "link") else x for x in label]
    def decided(order: range) -> tuple[list, list]:
        """Of each block, the nearest decided one before it in ``order``, and the nearest of its kind."""
        near, alike, last, of_kind = [None] * n, [None] * n, None, {}
        for i in order:
            near[i], alike[i] = last, of_kind.get(blocks[i].kind)
            if label[i] in ("good", "bad"):
                last = i
                of_kind[blocks[i].kind] = i
        return near, alike

    (before, kin_before), (after, kin_after) = decided(range(n)), decided(range(n - 1, -1, -1))
    final = list(label)

    def pick(i: int, a: int | None, b: int | None, edge_a: int, edge_b: int) -> str:
        x, y = ("bad" if k is None else label[k] for k in (a, b))
        if x == y:
            return x
        da, db = (i - a if a is not None else edge_a), (b - i if b is not None else edge_b)
        if da == db:
            return "good" if label[i] == "long" else "bad"
        return x if da < db else y

    for i in range(n - 1, -1, -1):  # headings look at what follows them, so from the end
        x, b = label[i], blocks[i]
        if x in ("good", "bad"):
            continue
        sides = [label[k] if k is not None else "bad" for k in (before[i], after[i])]
        kin = [k for k in (kin_before[i], kin_after[i]) if k is not None and b.kind[0] not in ANY_KIND]
        if x == "link":
            final[i] = "good" if sides == ["good", "good"] else "bad"
        elif kin:
            final[i] = label[min(kin, key=lambda k: (abs(k - i), label[k] == "bad"))]
        elif b.heading:
            final[i] = final[i + 1] if i + 1 < n else sides[0]
        elif "good" in sides and b.place == "main":
            final[i] = "good"
        else:
            final[i] = pick(i, before[i], after[i], i + 1, n - i)
    return [(f == "good", w) for f, w in zip(final, why, strict=True)]


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, (good, _) in zip(blocks, judge(blocks), strict=True) if good)


def share_of_reasons(pages: list[str]) -> Counter:
    """How many characters of block text each reason decided."""
    out: Counter = Counter()
    for p in pages:
        blocks = blocks_of(p)
        for b, (_, why) in zip(blocks, judge(blocks), strict=True):
            out[why] += len(b.text)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.record_batch([part.column(0), part.column(1), pa.array([main_text(x.as_py()) for x in part.column(2)], pa.string())], ["page_id", "url", "text"])

    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return spread(base).mapInArrow(run, "page_id long, url string, text string")
