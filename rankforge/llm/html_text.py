"""Main text of web pages by two passes over blocks.

A page is read once: tags open and close elements, block-level ones end the
current block. Text inside scripts, styles, menus, headers, footers, sidebars,
forms and elements marked as advert, notice, comment or the like belongs to
decided-out blocks.

First pass: a block with many links is out; a long block with enough stop words
is in; a long one without them is out unless an article element holds it;
everything else stays open. Second pass: an open block takes the label of its
nearest decided neighbours. Inside an article element only neighbours of that
article count and its borders count as in; elsewhere the page's borders count
as out. Headings look forward first.

Character references are decoded, white space inside a block becomes one space,
blocks are joined by one space in page order. Defined cases: null html gives an
empty text; unclosed and stray tags are tolerated, also those of elements whose
content is skipped: only an unclosed script, style, textarea or title ends the
page, as in a browser; whole pages are read in linear time however long they
are. Inside an article only a whole class name or id marks an element, and
figures keep their captions.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from rankforge.llm.rows import with_report

LONG = 70
STOP_SHARE = 0.12
LINK_SHARE = 0.5

# fixed values: frequent function words of four languages
STOP_WORDS = frozenset(
    "the of and to in is a that it for was on are as with his they at be this from have or by one had not but what all were when"
    " der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach"
    " de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou son lui"
    " el y los del se las por con para al lo como más pero sus su ya o este sí porque esta entre cuando muy sin sobre".split()
)
# fixed values: elements by their role in a page
RAW = frozenset("script style noscript template iframe textarea title svg math object select".split())
# everything up to their end tag is text, whatever it looks like
TEXT_ONLY = frozenset("script style textarea title".split())
SELF_CLOSING = frozenset("svg math object".split())
OUT = frozenset("nav header footer aside form button dialog menu fieldset label option head figure".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(["article", "main"])
MARKS = frozenset(
    "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion banner sidebar menu nav navbar navigation"
    " breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice newsletter subscribe subscription popup modal"
    " overlay comment comments respond replies related recommended share sharing social widget toolbar pagination pager copyright".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NEVER_MARKED = frozenset(["html", "body", "main", "article"])

_CLOSE = {name: re.compile("</" + name, re.I | re.A) for name in TEXT_ONLY}
_RAW_TAG = re.compile(rf"<!--|<(/?)({'|'.join(sorted(RAW))})(?=[\s/>])", re.I | re.A)
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s>=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_TOKEN = re.compile(r"[a-zA-Z]+")


class _Ends:
    """Where tags end, minding quoted attribute values; linear over a whole page."""

    def __init__(self, text):
        self.text, self.missing = text, {}

    def find(self, what, start):
        if start >= self.missing.get(what, len(self.text) + 1):
            return -1
        at = self.text.find(what, start)
        if at < 0:
            self.missing[what] = start
        return at

    def tag(self, start):
        """Position after the tag that begins at ``start``; -1 if it never ends."""
        end = self.find(">", start)
        if end >= 0 and "=" not in self.text[start:end]:
            return end + 1
        at = start
        while end >= 0:
            quotes = [q for q in (self.text.find("=" + mark, at, end) for mark in ('"', "'")) if q >= 0]
            if not quotes:
                return end + 1
            mark = min(quotes) + 1
            close = self.find(self.text[mark], mark + 1)
            if close < 0:
                return end + 1
            at = close + 1
            if close > end:
                end = self.find(">", close)
        return -1


def _raw_ends(page, ends):
    """Where each closed raw element ends, by the place of its opening tag."""
    found, opened, at = {}, {name: [] for name in RAW}, 0
    while m := _RAW_TAG.search(page, at):
        if not m.group(2):
            at = ends.find("-->", m.end()) + 3
            if at < 3:
                break
            continue
        name, start = m.group(2).lower(), m.start()
        at = ends.tag(start)
        if at < 0:
            at = m.end()
        elif m.group(1):
            if opened[name]:
                found[opened[name].pop()] = at
        elif name in TEXT_ONLY:
            stop = _CLOSE[name].search(page, at)
            if not stop:
                break
            after = page.find(">", stop.end())
            at = found[start] = len(page) if after < 0 else after + 1
        elif name not in SELF_CLOSING or page[at - 2] != "/":
            opened[name].append(start)
    return found


def _marked(name, attributes, article):
    if name in NEVER_MARKED or name == "a":
        return False
    if _HIDDEN.search(attributes):
        return True
    for m in _ATTRIBUTE.finditer(attributes):
        value = (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if m.group(1).lower() == "role":
            if value.strip() in ROLES:
                return True
        elif any(t in MARKS for t in (value.split() if article else _TOKEN.findall(value))):
            return True
    return False


def blocks(page):
    """(text, link characters, out, article number or 0, heading) of each block in page order."""
    ends = _Ends(page)
    raw_ends = None
    found, pieces, linked = [], [], 0
    # open elements as (name, out, article, link, heading) of what they hold
    stack, counts = [("", False, 0, False, False)], {}
    articles, at = 0, 0

    def close_block():
        nonlocal pieces, linked
        text = " ".join("".join(pieces).split())
        if text:
            _, out, article, _, heading = state
            found.append((text, linked, out, article, heading))
        pieces, linked = [], 0

    def add(text):
        nonlocal linked
        if text:
            text = entities.unescape(text) if "&" in text else text
            pieces.append(text)
            if state[3]:
                linked += len(text.strip())

    state = stack[-1]
    while True:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        if page.startswith("<!--", start):
            end = ends.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = ends.find(">", start)
            at = len(page) if end < 0 else end + 1
            continue
        m = _NAME.match(page, start + 1)
        end = ends.tag(start) if m else -1
        if end < 0:
            add("<")
            at = start + 1
            continue
        name, at = m.group(1).lower(), end
        if name == "br":
            pieces.append(" ")
            continue
        if page[start + 1] == "/":
            if counts.get(name):
                if name in BLOCK:
                    close_block()
                while True:
                    gone = stack.pop()[0]
                    counts[gone] -= 1
                    if gone == name:
                        break
                state = stack[-1]
            elif name in BLOCK:
                close_block()
            continue
        if name in BLOCK:
            close_block()
        if name in BLOCK or name == "option":
            while state[0] == "option":
                counts[stack.pop()[0]] -= 1
                state = stack[-1]
        if name in ("p", "li") and state[0] == name:
            counts[stack.pop()[0]] -= 1
            state = stack[-1]
        if name in RAW:
            raw_ends = _raw_ends(page, ends) if raw_ends is None else raw_ends
            if start in raw_ends:
                at = raw_ends[start]
            elif name in TEXT_ONLY:
                break
            continue
        if name in VOID or page[end - 2] == "/":
            continue
        attributes = page[start + 1 + len(name) : end - 1]
        _, out, article, link, heading = state
        if name in MAIN and not article:
            articles += 1
            article = articles
        boilerplate = name in OUT and not (article and name == "figure")
        out = out or boilerplate or (bool(attributes) and _marked(name, attributes, article))
        heading = heading or (len(name) == 2 and name[0] == "h" and name[1] in "123456")
        stack.append((name, out, article, link or name == "a", heading))
        counts[name] = counts.get(name, 0) + 1
        state = stack[-1]
    close_block()
    return found


def _decide(block):
    """True in, False out, None open."""
    text, linked, out, article, heading = block
    if out or linked > LINK_SHARE * len(text):
        return False
    if len(text) < LONG or heading:
        return None
    words = text.lower().split()
    if sum(map(STOP_WORDS.__contains__, words)) >= STOP_SHARE * len(words):
        return True
    return None if article else False


def _inherit(found, labels):
    """Second pass: each open block's label, from the nearest decided ones before and after."""
    n = len(found)
    before, after = [None] * n, [None] * n
    seen = None
    for i in range(n):
        if labels[i] is not None and not found[i][2]:
            seen = (i, labels[i], found[i][3])
        elif labels[i] is not None and not found[i][3]:
            seen = (i, False, 0)
        before[i] = seen
    seen = None
    for i in reversed(range(n)):
        if labels[i] is not None and (not found[i][2] or not found[i][3]):
            seen = (i, labels[i], found[i][3])
        after[i] = seen
    done = list(labels)
    for i in range(n):
        if labels[i] is not None:
            continue
        article, heading = found[i][3], found[i][4]
        left, right = before[i], after[i]
        if article:
            # borders of the article count as in
            left = left if left and left[2] == article else (-1, True, article)
            right = right if right and right[2] == article else (n, True, article)
            done[i] = left[1] or right[1]
        else:
            left, right = left or (-1, False, 0), right or (n, False, 0)
            if left[1] == right[1]:
                done[i] = left[1]
            elif heading:
                done[i] = right[1]
            else:
                done[i] = left[1] if i - left[0] < right[0] - i else right[1] if right[0] - i < i - left[0] else False
    return done


def main_text(page):
    """Main text of one page's html."""
    found = blocks(page or "")
    labels = _inherit(found, [_decide(b) for b in found])
    return " ".join(b[0] for b, keep in zip(found, labels) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(row, main_text) for each row of ``pages`` (needs ``html``)."""
    return with_report(
        pages, "html", lambda texts: [pa.array([main_text(t.as_py()) for t in texts], pa.string())], "main_text string"
    )
