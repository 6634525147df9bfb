"""Fields of raw pages by element.

A field names elements by a path of compound selectors (``tag#id.class``,
descendant by a space, child by ``>``). Pages are read in Arrow batches, each
in one pass with a stack of open elements, so the work is linear in a page and
nothing but the open elements and the fields' texts is held. Names are
case-insensitive; ends that HTML leaves out (a paragraph before the next block,
a list item before the next) are implied.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of HTML: elements without an end, blocks that end an open paragraph,
# elements that end an open one of their kind, and elements that neither looks beyond.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr main menu nav ol p pre section table ul".split())
ENDS_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("button caption html table ul ol dl select".split())
NO_TEXT = frozenset({"script", "style"})


@dataclass(frozen=True)
class Field:
    """``many``: the list of all matches; ``joined``: all matches in one string;
    else the first match (null if none). ``attr``: the attribute instead of the
    text. ``first``: only so many characters."""
    name: str
    path: str
    attr: str | None = None
    many: bool = False
    joined: bool = False
    lower: bool = False
    first: int | None = None


# Where an article page holds its fields.
ARTICLE_FIELDS = [
    Field("journal", "#full-view-journal-trigger", attr="title"),
    Field("mesh_major", "#mesh-terms > ul li div button", many=True, lower=True),
    Field("year", "#full-view-heading > div.article-citation > div.article-source > span.cit", first=4),
    Field("abstract", "#eng-abstract > p", joined=True),
    Field("title", "#full-view-heading > h1"),
]

_COMPOUND = re.compile(r"([A-Za-z][\w-]*|\*)?((?:[#.][\w-]+)*)")


def parse_path(path: str) -> list[tuple[bool, str | None, str | None, frozenset]]:
    """Steps (child of the step before, tag, id, classes) of a path."""
    steps, child = [], False
    for word in path.replace(">", " > ").split():
        if word == ">":
            child = True
            continue
        m = _COMPOUND.fullmatch(word)
        if not m:
            raise ValueError(f"not a path of elements: {path!r}")
        marks = re.findall(r"([#.])([\w-]+)", m[2])
        steps.append((child, None if m[1] in (None, "*") else m[1].lower(),
                      next((v for k, v in marks if k == "#"), None), frozenset(v for k, v in marks if k == ".")))
        child = False
    if not steps:
        raise ValueError("an empty path")
    return steps


class _Page(HTMLParser):
    def __init__(self, fields: list[Field], paths: list):
        super().__init__(convert_charrefs=True)
        self.fields, self.paths = fields, paths
        self.open: list[tuple[str, str | None, frozenset, list]] = []  # tag, id, classes, texts being taken
        self.count: dict[str, int] = {}  # of open elements by tag
        self.taking: list[list[str]] = []
        self.found: list[list] = [[] for _ in fields]

    def _holds(self, path, at: int, i: int) -> bool:
        """Whether step ``at`` of a path is open element ``i`` and the steps before lie above it."""
        child, tag, ident, classes = path[at]
        name, own, has, _ = self.open[i]
        if tag not in (None, name) or ident not in (None, own) or not classes <= has:
            return False
        if at == 0:
            return True
        above = range(i - 1, max(i - 2, -1) if child else -1, -1)
        return any(self._holds(path, at - 1, j) for j in above)

    def _pop_to(self, i: int) -> None:
        while len(self.open) > i:
            tag, _, _, taken = self.open.pop()
            self.count[tag] -= 1
            if taken:  # the innermost of those being taken
                del self.taking[-len(taken):]

    def _imply(self, kinds: set, scope: frozenset) -> None:
        if not any(self.count.get(k) for k in kinds):
            return None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in kinds:
                return self._pop_to(i)
            if self.open[i][0] in scope:
                return None

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._imply({"p"}, SCOPE)
        if tag in ENDS_KIND:
            self._imply(ENDS_KIND[tag], SCOPE)
        given = dict(reversed(attrs))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.open.append((tag, given.get("id"), frozenset((given.get("class") or "").split()), []))
        for n, (field, path) in enumerate(zip(self.fields, self.paths)):
            if self._holds(path, len(path) - 1, len(self.open) - 1):
                if field.attr is not None:
                    if given.get(field.attr) is not None:
                        self.found[n].append([given[field.attr]])
                else:
                    texts: list[str] = []
                    self.found[n].append(texts)
                    self.open[-1][3].append(texts)
                    self.taking.append(texts)
        if tag in VOID:
            self._pop_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        if not self.count.get(tag):
            return None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                return self._pop_to(i)

    def handle_data(self, data):
        if self.taking and not (self.open and self.open[-1][0] in NO_TEXT):
            for texts in self.taking:
                texts.append(data.strip())

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, report)


def page_fields(html: str | None, fields: list[Field], paths: list | None = None) -> list:
    """Values of the fields of one page, in their order."""
    page = _Page(fields, paths or [parse_path(f.path) for f in fields])
    page.feed(html or "")
    page.close()
    out = []
    for f, found in zip(fields, page.found):
        texts = ["".join(x) for x in found]
        texts = [x.lower() if f.lower else x for x in texts]
        texts = [x[:f.first] for x in texts]
        out.append(texts if f.many else "".join(texts) if f.joined else texts[0] if texts else None)
    return out


def element_fields(pages: DataFrame, fields: list[Field] | None = None, html: str = "html") -> DataFrame:
    """The fields of every page beside its other columns (``html`` goes).

    Texts are those of the element and all within it, each piece stripped and
    put together without a space; character references are decoded; scripts
    and styles give no text. Null and empty pages give null, ``""`` (joined)
    or an empty list. Raises ValueError for a path that cannot be read or a
    field named like another column, before any job.
    """
    fields = list(fields or ARTICLE_FIELDS)
    paths = [parse_path(f.path) for f in fields]
    kept = [c for c in pages.columns if c != html]
    names = [*kept, *(f.name for f in fields)]
    if len({x.lower() for x in names}) != len(names):
        raise ValueError(f"names stand twice: {names}")
    kinds = [pa.list_(pa.string()) if f.many else pa.string() for f in fields]
    schema = T.StructType([pages.schema[c] for c in kept] + [
        T.StructField(f.name, T.ArrayType(T.StringType()) if f.many else T.StringType()) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [page_fields(x.as_py(), fields, paths) for x in b.column(html)]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.record_batch([*(b.column(c) for c in kept), *cols], names=names)

    return pages.select(*kept, html).mapInArrow(run, schema)
