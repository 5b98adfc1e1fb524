"""Main text of web pages by two passes of block rules.

First each block is classified alone, by where it stands and by its length, link density and stop-word density; blocks
that this leaves open then take the label of the nearest decided blocks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that end a block, that are skipped with their content, that hold no main text, and that have no end tag.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = set("script style noscript template textarea iframe object svg math canvas head select option button title".split())
CHROME = set("nav footer aside form menu dialog".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of class names, ids and ARIA roles that mark what isn't main text.
MARKS = set("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice overlay pagination pager popup promo promoted related replies respond share sharing sidebar signup social sponsor sponsored subscribe widget".split())
#: Frequent function words of the languages supported.
STOPS = set(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "als am auch auf aus bei das dem den der des die durch ein eine einem einen einer es für ich im ist mit nicht sich sie sind und vom von war wie wird zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur mais ne nous par pas plus pour que qui sa se ses son sont sur un une vous "
    "al como con del el ella ellos esta este ha hay lo los las más me mi muy no o para pero por se sin su sus una uno y ya".split()
)
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKED = 70, 200, 0.15, 0.30, 0.35

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_MARK = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[^\W\d_]+")
GOOD, BAD, OPEN = 1, -1, 0


def _marked(attrs: str) -> bool:
    return any(part in MARKS for m in _MARK.findall(attrs) for part in re.split(r"[\s_-]+", "".join(m).lower()))


class Block:
    __slots__ = ("text", "linked", "chrome", "article", "heading")

    def __init__(self, text: str, linked: int, chrome: bool, article: bool, heading: bool):
        self.text, self.linked, self.chrome, self.article, self.heading = text, linked, chrome, article, heading


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool]] = []
    parts: list[str] = []
    state = {"a": 0, "linked": 0, "chrome": 0, "article": 0, "heading": False}

    def text(raw: str) -> None:
        if raw:
            raw = html.unescape(raw)
            parts.append(raw)
            if state["a"]:
                state["linked"] += len("".join(raw.split()))

    def flush() -> None:
        if parts:
            if joined := " ".join("".join(parts).split()):
                out.append(Block(joined, state["linked"], state["chrome"] > 0, state["article"] > 0, state["heading"]))
            parts.clear()
        state["linked"], state["heading"] = 0, False

    def leave(upto: int) -> None:
        while len(stack) > upto:
            name, chrome = stack.pop()
            state["chrome"] -= chrome
            state["article"] -= name in ("article", "main")

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        closing, attrs = (m[1] if m[2] else m[4]), (m[3] if m[2] else m[6]) or ""
        if name in SKIPPED:
            if name == "head":
                if not closing and (end := re.compile(r"</head\s*>|<body\b", re.I).search(page, at)):
                    at = end.start() if end[0][1] != "/" else end.end()
            elif not closing and not attrs.endswith("/") and name != "option":
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else n if name in ("script", "style", "textarea", "title") else at
            continue
        if name == "a":
            state["a"] = 0 if closing else 1
        if name == "br":
            parts.append(" ")
        if name not in BLOCKS:
            if not closing and name not in VOID and _marked(attrs) and not attrs.endswith("/"):
                flush()
                stack.append((name, True))
                state["chrome"] += 1
            elif closing and stack and any(x == name for x, _ in stack[-8:]) and stack[-1][0] == name:
                flush()
                leave(len(stack) - 1)
            continue
        flush()
        if name in ("p", "hr"):
            continue
        if closing:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if k is not None:
                leave(k)
                state["a"] = 0
            continue
        if name in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
            leave(len(stack) - 1)
        chrome = name in CHROME or name == "header" and not state["article"] or name not in ("body", "html", "article", "main") and _marked(attrs)
        stack.append((name, chrome))
        state["chrome"] += chrome
        state["article"] += name in ("article", "main")
        state["heading"] = name in ("h1", "h2", "h3", "h4", "h5", "h6")
    flush()
    return out


def classify(b: Block) -> int:
    """A block's label from itself alone; OPEN leaves it to its neighbours."""
    n = len(b.text)
    if b.chrome or b.linked > LINKED * n and not (b.article and b.linked < 0.8 * n):
        return BAD
    if n < SHORT or b.heading:
        return OPEN
    found = _WORD.findall(b.text.lower())
    stops = sum(w in STOPS for w in found) / len(found) if found else 0.0
    if stops >= STOP_HIGH and n >= LONG or b.article and stops >= STOP_LOW:
        return GOOD
    return OPEN if stops >= STOP_LOW or b.article else BAD


def main_text(page: str | None) -> str:
    """The main text: good blocks in page order, joined by a line feed. Where a page has article or main elements and most
    of what is good by itself stands in them, nothing else is; open blocks there that have no decided neighbour are good."""
    found = blocks(page or "")
    labels = [classify(b) for b in found]
    size = lambda inside: sum(len(b.text) for b, x in zip(found, labels) if x == GOOD and b.article == inside)
    if any(b.article and not b.chrome for b in found) and size(True) >= size(False):
        for i, b in enumerate(found):
            b.chrome = b.chrome or not b.article
            labels[i] = labels[i] if b.article else BAD
    own = [i for i, b in enumerate(found) if not b.chrome]  # neighbours are sought among what isn't the page's frame
    decided = [i for i in own if labels[i] != OPEN]
    rank = {i: k for k, i in enumerate(own)}
    before, after, last = {}, {}, None
    for i in own:
        before[i] = last
        last = i if labels[i] != OPEN else last
    last = None
    for i in reversed(own):
        after[i] = last
        last = i if labels[i] != OPEN else last
    final = dict.fromkeys(own, GOOD) if not decided else {}
    for i in own if decided else []:
        near = [(abs(rank[j] - rank[i]), -labels[j], labels[j]) for j in (before[i], after[i]) if j is not None]
        final[i] = labels[i] if labels[i] != OPEN else min(near)[2]
    return "\n".join(found[i].text for i in own if final[i] == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    A null or empty page, and one without main text, has an empty text. Pages are independent of each other: repeated
    rows give repeated results, other columns don't matter, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
