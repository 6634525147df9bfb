"""Blocks of an HTML page with what its markup says of each (plain Python, one page at a time).

A block is the text between two block-level tags. Its kind:

* ``A`` inside an ``article``,
* ``M`` inside ``main`` (or role main), outside an article,
* ``C`` inside markup that names something else: menus, page headers, footers,
  sidebars, forms, adverts, notices, comments, hidden parts,
* ``U`` none of these.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

# Elements by what they mean (HTML standard).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr br input picture source button select output".split())
VOID = frozenset("area base basefont br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head template noscript svg canvas audio video object applet map datalist math".split())
SOFT = frozenset("nav menu form fieldset dialog search button select".split())
HARD = frozenset("aside footer".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words of class and id that name boilerplate. The first list gives way to an article inside it.
SOFT_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
                       "gdpr notice notices popup modal overlay newsletter subscribe signup login menu nav navbar navigation "
                       "breadcrumb breadcrumbs masthead toolbar pagination pager share sharing social widget skip sidebar".split())
HARD_WORDS = frozenset("comment comments disqus replies reply related recommended footer".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""[\s"'/](class|id|role|style|hidden|aria-hidden)(?=[\s=>/])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@lru_cache(maxsize=4096)
def _label(tag: str) -> tuple[bool, bool, bool]:
    """(soft, hard, main) by the attributes of a start tag."""
    soft = hard = main = False
    for m in _ATTRIBUTE.finditer(tag):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            said = {w.lower() for w in _WORDS.findall(value)}
            soft |= bool(said & SOFT_WORDS)
            hard |= bool(said & HARD_WORDS)
        elif name == "role":
            main |= value.strip().lower() in ("main", "article")
            hard |= value.strip().lower() in ROLES
        elif name == "style":
            hard |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:  # hidden, aria-hidden
            hard |= name == "hidden" and value.lower() != "until-found" or value.lower() == "true"
    return soft, hard, main


_NOTHING = (False, False, False)


def _space(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def blocks(html: str) -> tuple[list[str], str]:
    """(texts, kinds) of the blocks in page order; character references are
    decoded, white space is one space, empty blocks are left out."""
    texts: list[str] = []
    kinds: list[str] = []
    body: list[str] = []     # text of the open block
    aside: list[str] = []    # inline text in it that its markup excludes
    kind = ""
    # open elements: (name, soft, hard, main, article); inline ones and paragraphs only where a label makes them matter
    stack: list[tuple] = [("", False, False, False, False)]
    count: dict[str, int] = {}

    def flush() -> None:
        nonlocal body, aside, kind
        for parts, k in ((body, kind), (aside, "C")):
            if parts and (text := _space(parts)):
                texts.append(text)
                kinds.append(k)
        body, aside, kind = [], [], ""

    def close(name: str) -> None:
        while len(stack) > 1:
            top = stack.pop()[0]
            count[top] -= 1
            if top == name:
                return

    def say(text: str, inline: bool) -> None:
        nonlocal kind
        if not text:
            return
        _, soft, hard, main, article = stack[-1]
        k = "C" if soft or hard else "A" if article else "M" if main else "U"
        text = unescape(text) if "&" in text else text
        if not text.strip():
            (body if body else aside).append(text)
        elif k == "C" and inline:
            aside.append(text)
        else:
            kind = kind or k
            body.append(text)

    at, n, low = 0, len(html), None
    while at < n:
        m = _TAG.search(html, at)
        inline = stack[-1][0] in INLINE
        if m is None:
            say(html[at:], inline)
            break
        say(html[at:m.start()], inline)
        at, tag = m.end(), m[0]
        if tag[1] in "!?":
            continue
        name = _NAME.match(tag)[1].lower()
        if tag[1] == "/":
            if name not in INLINE and name not in RAW:
                flush()
            if count.get(name):
                close(name)
            continue
        if name == "br":
            (body if body else aside).append(" ")
            continue
        if name in RAW:
            low = html.lower() if low is None else low
            end = low.find("</" + name, at) if len(low) == n else -1
            if len(low) != n:  # lower() changed the length: look without it
                found = re.compile("</" + name, re.I).search(html, at)
                end = found.start() if found else -1
            at = n if end < 0 else end
            continue
        soft, hard, main = _label(tag) if " " in tag or "\n" in tag or "\t" in tag or "/" in tag else _NOTHING
        if name in INLINE:
            if name not in VOID and (soft or hard or count.get(name) or name in SOFT):
                _push(stack, count, name, soft or name in SOFT, hard, False, False)
            continue
        flush()
        if count.get("p"):
            close("p")
        if name in VOID:
            continue
        if name == "body":
            if count.get("head"):
                close("head")
            soft = hard = False
        if name == "html":
            continue
        if name == "p":
            if soft or hard:
                _push(stack, count, name, soft, hard, False, False)
            continue
        own = stack[-1]
        soft |= name in SOFT or name == "header" and not (own[3] or own[4])
        hard |= name in HARD or name in UNSEEN
        _push(stack, count, name, soft, hard, main or name == "main", name == "article")
    flush()
    return texts, "".join(kinds)


def _push(stack: list[tuple], count: dict[str, int], name: str, soft: bool, hard: bool, main: bool, article: bool) -> None:
    _, s, h, m, a = stack[-1]
    if (main or article) and not (h or hard):
        s = soft = False  # an article inside, say, a form or a menu never closed
    stack.append((name, s or soft, h or hard, m or main, a or article))
    count[name] = count.get(name, 0) + 1
