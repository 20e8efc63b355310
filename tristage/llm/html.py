"""Main text of web pages by two passes over blocks.

The first pass decides blocks by their share of stop words, their length and their share of linked characters, and by
where they stand: places are weighed by how much running text they hold, so an article counts before the open page, the
open page before a form, a form before what its class names call something else. Short blocks that this leaves open
inherit, in the second pass, from the nearest decided blocks before and after them, and so do long blocks of an article
that hardly hold a stop word. Ties: of two undecided neighbours as near the one before counts; of places that hold as
much text the likelier.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import ship

#: Common function words of four languages, our choice.
STOP = frozenset("""
the of and to in a is that for it on was with be as by are this or at from not have an they which one you were all
we when your can there use each will how if do but his her he she its their has had would been who our more no so
de la le et les des en un une du est que qui dans pour par sur pas au ne plus avec il se sont ce cette ou mais nous
vous ils elle aux ses son sa leur être avoir comme
der die und das den von zu mit ist des im für auf nicht ein eine als auch es an werden aus er hat dass sie nach wird
bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man
el los las del se con por para una no su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin
sobre ser tiene también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante
""".split())
#: Fixed values of the format: elements whose content is no markup, elements that break blocks, elements without end.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BREAKS = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article, and those whose text belongs to a form; our choice.
OUTSIDE = frozenset("nav footer aside menu dialog search template head".split())
CONTROL = frozenset("button select option optgroup datalist label legend output".split())
#: Words of a class, id or role that name something else than the article: "site-footer" and "comment-thread" do, whatever
#: stands beside them. Names that only say what an element has or lacks do not: "has-sidebar", "no-comments". Our choice.
HINTS = frozenset("""
ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie
cookies consent disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices
notification alert pager pagination popup promo promoted promotion related reply replies respond search share sharing
sharebar sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets masthead
contentinfo complementary copyright teaser teasers
""".split())
SAYS = frozenset("has have with no non without not free and".split())

_CLOSE = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_END = re.compile(r"""(>)|=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))""")
_PART = re.compile(r"[-_:.0-9]+|(?<=[a-z])(?=[A-Z])")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Characters of a long block, share of stop words in a good one, share of linked characters in a bad one.
LONG, DENSE, LINKED = 70, 0.2, 0.5
#: Places, the likeliest first.
ARTICLE, OPEN, FORM, HINTED, NEVER = range(5)


def scan(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kind text, open, empty or close; time grows with the length only.

    An unfinished tag is text; a quote that is never closed is none; a comment that is never closed takes the rest.
    """
    at, last, open_quotes, unclosed = 0, html.rfind(">"), set(), set()
    text = 0  # where the text at hand begins
    while True:
        at = html.find("<", at)
        if at < 0 or at > last:
            break
        nxt = html[at + 1 : at + 2]
        close = nxt == "/"
        name = _NAME.match(html, at + 1 + close)
        if name is None:
            if nxt not in ("!", "?", "/"):
                at += 1
                continue
            if text < at:
                yield "text", html[text:at], ""
            comment = html.startswith("<!--", at)
            end = html.find("-->", at + 2) if comment else html.find(">", at)
            at = text = len(html) if end < 0 else end + (3 if comment else 1)
            continue
        if text < at:
            yield "text", html[text:at], ""
        stop = name.end()
        while True:
            m = _END.search(html, stop)
            if m is None or m[1]:
                break
            stop = m.end()
            if m[2] not in open_quotes:
                end = html.find(m[2], stop)
                if end < 0:
                    open_quotes.add(m[2])
                else:
                    stop = end + 1
        if m is None:  # a quoted > was the last one
            text, last = at, -1
            break
        attributes, tag = html[name.end() : m.start()], name[0].lower()
        at = text = m.end()
        if close:
            yield "close", tag, ""
        elif tag in RAW and not attributes.endswith("/"):
            yield "empty", tag, attributes
            if tag not in unclosed:
                found = _CLOSE[tag].search(html, at)
                if found:
                    at = text = found.start()
                elif tag in ("script", "style"):
                    at = text = len(html)
                else:
                    unclosed.add(tag)
        else:
            yield "empty" if attributes.endswith("/") or tag in VOID else "open", tag, attributes
    if text < len(html):
        yield "text", html[text:], ""


class Block:
    __slots__ = ("parts", "linked", "place", "heading", "text", "dense")

    def __init__(self, place: int, heading: bool):
        self.parts, self.linked, self.place, self.heading = [], 0, place, heading


def named(attributes: str) -> bool:
    """Whether a class, id or role names something else than the article."""
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            for token in (m[2] or m[3] or m[4] or "").split():
                parts = [x.lower() for x in _PART.split(token) if x]
                if any(x in HINTS for x in parts) and not any(x in SAYS for x in parts):
                    return True
    return False


def _place(name: str, attributes: str, now: int, depth: Counter) -> int:
    """Where the content of an element stands, if the element around it stands in `now`."""
    if now == NEVER or name in ("html", "body"):
        return now
    if name in OUTSIDE or name in CONTROL:
        return NEVER
    hint = bool(attributes) and named(attributes)
    if name in ("article", "main") or 'role="main"' in attributes or 'role="article"' in attributes:
        # an article within something else, or named as such, may be a comment or a teaser
        return HINTED if now == HINTED or hint and depth["article"] > 1 else ARTICLE
    if name == "header" and now != HINTED and depth["article"] + depth["main"] == 0:
        return NEVER
    if hint:
        return HINTED
    return max(now, FORM) if name == "form" else now


def blocks(html: str) -> list[Block]:
    """Text between breaks, each with where it stands."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # element, where its text stands
    depth: Counter[str] = Counter()
    link: int | None = None  # depth of the stack where a link began
    breaks, block, last_br = 0, None, False

    def put(b: Block, data: str) -> None:
        b.parts.append(data)
        if link is not None:
            b.linked += len(data.strip())

    for kind, name, attributes in scan(html):
        if kind == "text":
            bare = not name.strip()
            if bare and block is None:
                continue
            place = stack[-1][1] if stack else OPEN
            heading = any(x in _HEADING for x, _ in stack[-3:])
            if depth["header"] and place == ARTICLE and not heading:
                place = NEVER  # in the header of an article only its headings count
            if block is not None and place != block.place and not bare:
                aside = Block(place, heading)  # an inline element that stands elsewhere
                out.append(aside)
                put(aside, name)
                continue
            if block is None:
                block = Block(place, heading)
                out.append(block)
            if not bare:
                breaks = 0
            put(block, name)
            continue
        if name == "br":
            breaks += 1
            if block is not None:
                block.parts.append(" ")
                if breaks > 1:
                    block = None
            continue
        if name in BREAKS:
            block, breaks = None, 0
        if kind == "close":
            if name == "a":
                link = None
            if depth[name]:
                while True:
                    gone = stack.pop()[0]
                    depth[gone] -= 1
                    if gone == name:
                        break
                if link is not None and len(stack) < link:
                    link = None
            continue
        if kind == "empty":
            continue
        if name in ("p", "li") and stack and stack[-1][0] == name:
            stack.pop()
            depth[name] -= 1
        if name in BREAKS or name in OUTSIDE or name in CONTROL or name == "span":
            depth[name] += 1
            stack.append((name, _place(name, attributes, stack[-1][1] if stack else OPEN, depth)))
        elif name == "a":
            link = len(stack)
    for b in out:
        b.text = " ".join(unescape("".join(b.parts)).split())
        words = b.text.lower().split()
        b.dense = sum(w.strip(".,;:!?()\"'") in STOP for w in words) / max(1, len(words))
    return [b for b in out if b.text]


def _running(b: Block) -> bool:
    return len(b.text) >= LONG and b.linked <= LINKED * len(b.text)


def places(found: list[Block]) -> int:
    """The last of the places that the main text of a page takes in."""
    mass = [sum(len(b.text) for b in found if b.place == p and (p == ARTICLE and b.linked <= LINKED * len(b.text) or _running(b))) for p in (ARTICLE, OPEN, FORM, HINTED)]
    if mass[ARTICLE] and 2 * mass[ARTICLE] >= mass[OPEN]:
        return ARTICLE
    short = sum(len(b.text) for b in found if b.place == OPEN and b.dense >= DENSE and b.linked <= LINKED * len(b.text))
    if not mass[OPEN] and short >= LONG // 2 and 2 * short >= max(mass[FORM], mass[HINTED]):
        return OPEN  # running text in short blocks
    return next((p for p in (OPEN, FORM, HINTED) if mass[p]), ARTICLE if any(b.place == ARTICLE for b in found) else OPEN)


def _decide(b: Block, last: int, known: bool) -> bool | None:
    """True: main text, False: not, None: open. known: whether stop words tell anything about this page."""
    if b.place > last:
        return False
    if b.linked > LINKED * len(b.text):
        return None if b.place == last == ARTICLE and len(b.text) < LONG else False
    if b.place == ARTICLE != last:  # an article beside the text is a teaser, unless it is text itself
        return b.dense >= DENSE or not known if len(b.text) >= LONG else None if b.heading else False
    if b.place == ARTICLE:  # a long block without stop words, such as a list, goes with its neighbours
        return True if b.dense >= DENSE or len(b.text) >= LONG and not known else None
    if "©" in b.text and len(b.text) < 2 * LONG:
        return False
    if len(b.text) >= LONG:
        return b.dense >= DENSE or not known
    return None


def extract(html: str | None) -> str:
    """Blocks of the main text, in page order, joined by line feeds."""
    found = blocks(html or "")
    last = places(found)
    known = any(b.place <= last and _running(b) and b.dense >= DENSE for b in found)
    labels = [_decide(b, last, known) for b in found]

    def nearest(order: Iterator[int]) -> list[tuple[int, bool | None]]:
        out, held = [(0, None)] * len(found), (0, None)
        for i in order:
            out[i] = held
            if labels[i] is not None and found[i].place <= last:
                held = (i, labels[i])
        return out

    before, after = nearest(iter(range(len(found)))), nearest(iter(range(len(found) - 1, -1, -1)))
    keep = []
    for i, b in enumerate(found):
        x = labels[i]
        if x is None:
            (p, left), (q, right) = before[i], after[i]
            if b.place == ARTICLE != last:
                x = bool(right)  # a heading goes with what follows it
            elif left is None or right is None:
                x = right if left is None else left
                x = True if x is None else x  # a page of short blocks only
            elif left == right:
                x = left
            else:
                x = b.place == ARTICLE or b.heading and right or (left if i - p <= q - i else right)
        if x:
            keep.append(b.text)
    return "\n".join(keep)


def main_text(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars. A null or empty html gives an empty text; a page of any length is read whole, in time
    that grows with its length; rows are taken one by one, so repeated rows are alike and an empty table gives an empty
    result; columns of pages with these two names are replaced, all others pass."""
    ship(pages.sparkSession)
    pages = pages.drop("text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(h) for h in batch.column("html").to_pylist()]
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "html"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=[*(n for n, _ in rest), "text", "n_chars"])

    kept = [f for f in pages.schema.fields if f.name != "html"]
    return pages.mapInArrow(run, StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())]))
