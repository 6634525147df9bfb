"""Operator 12, HTML extraction: host suffix arrays.

Pages are read into blocks (``mainblocks``). The pages of a host are dealt to
parts of a bounded size; the token streams of a part's pages are concatenated,
each page between edge tokens of its own kind, and their suffixes sorted by
prefix doubling up to ``least_run`` tokens. Suffixes of one class start the same
long substring; where a class has enough pages of different content, its
places are covered. Blocks whose words are covered are boilerplate; unique runs
stay.

In a host of several parts a long substring that is repeated often enough has
its share of pages in some part, so the arrays of the parts name candidates,
which are then counted over all parts: the parts do not change the result.

Repeats alone cannot be right on real hosts: articles are copied, quoted and
syndicated (11 % of the article paragraphs of check_s stand on two pages of
their host, 30 % of check_h), and the menu of a host's only page repeats
nowhere. So the markup has a say where it is explicit: an ``article`` is never
dropped for being repeated, and what the markup names as a menu, footer, form,
advert or comment is dropped even if unique. All else is decided by the arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalake.llm import words as W
from qalake.llm.mainblocks import blocks
from qalake.llm.store import written
from qalake.llm.urls import host_path

MAIN = "page_id long, url string, text string, n_chars long, n_repeated long, n_named long"
MAIN_SCHEMA = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in MAIN.split(", ")])


@dataclass(frozen=True)
class PageParams:
    least_run: int = 8            # tokens of a long substring, a power of two
    least_pages: int = 2          # pages of different content that hold it
    least_share: float = 0.01     # share of the host's contents that hold it
    cover: float = 0.8            # covered share of a block's words that makes it boilerplate
    part_bytes: int = 8 << 20     # html of a part
    most_sent: int = 100_000      # hosts of several parts that are broadcast; more are joined by a shuffle


def suffix_classes(s: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix of ``s`` (values from 0) the rank of its first ``depth``
    tokens (a power of two) among all suffixes: prefix doubling, where only
    suffixes that still share their rank are sorted again. A suffix that ends
    earlier ranks below."""
    order = np.argsort(s, kind="stable")
    rank = _ranks(s[order], order)
    k = 1
    active = order[_shared(rank[order])]
    while k < depth and len(active):
        follow = np.where(active + k < len(s), rank[np.minimum(active + k, len(s) - 1)], -1)
        o = np.lexsort((follow, rank[active]))
        active, follow, first = active[o], follow[o], rank[active[o]]
        new_class = np.ones(len(active), bool)
        new_class[1:] = first[1:] != first[:-1]
        new = new_class.copy()
        new[1:] |= follow[1:] != follow[:-1]
        at = np.arange(len(active))
        rank[active] = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_class, at, 0))
        active = active[_shared(rank[active])]
        k *= 2
    return rank


def _ranks(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rank of each position: the place in sorted order where its class starts."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    rank = np.empty(len(values), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    return rank


def _shared(sorted_ranks: np.ndarray) -> np.ndarray:
    same = np.zeros(len(sorted_ranks), bool)
    same[1:] = sorted_ranks[1:] == sorted_ranks[:-1]
    same[:-1] |= same[1:]
    return same


@dataclass
class Stream:
    """Pages one after the other: run - 1 edge tokens, the page's tokens,
    run - 1 edge tokens, a token that no other page has. ``at`` is the place of
    each word, ``end`` of each page's own token, ``of`` the page of each place;
    ``windows`` start the runs that stay inside their page and hold a word of it."""

    at: np.ndarray
    end: np.ndarray
    of: np.ndarray
    windows: np.ndarray


def stream(page: np.ndarray, n_pages: int, run: int) -> Stream:
    per = np.bincount(page, minlength=n_pages)
    size = per + 2 * (run - 1) + 1
    start = np.cumsum(size) - size
    total = int(size.sum())
    at = np.arange(len(page)) + np.repeat(start + run - 1 - (np.cumsum(per) - per), per)
    of = np.repeat(np.arange(n_pages), size)
    held = np.zeros(total + 1, np.int64)
    held[1:][at] = 1
    held = np.cumsum(held)
    window = np.arange(total) + run <= start[of] + size[of] - 1
    window &= held[np.minimum(np.arange(total) + run, total)] > held[:-1]
    return Stream(at, start + size - 1, of, np.flatnonzero(window))


def contents(x: Stream, hashes: np.ndarray) -> np.ndarray:
    """A hash of each page's distinct windows, given one for each window: copies
    of a page are one content, whatever the other pages are."""
    # 40 bits of a hash below the page; a part has far fewer than 2**24 pages
    low = np.uint64(40)
    k = np.sort(x.of[x.windows].astype(np.uint64) << low | hashes >> np.uint64(24))
    k = k[np.concatenate([[True], k[1:] != k[:-1]])[:len(k)]]
    sums = np.zeros(len(k) + 1, np.uint64)
    np.cumsum(W.mix((k & np.uint64((1 << 40) - 1)) + np.uint64(1)), out=sums[1:])
    to = np.searchsorted(k >> low, np.arange(len(x.end) + 1, dtype=np.uint64))
    return sums[to[1:]] - sums[to[:-1]]


def classes(x: Stream, tokens: np.ndarray, run: int) -> np.ndarray:
    """For each window of ``x`` (words are values from 0) the class of its long substring."""
    top = int(tokens.max()) + 1 if len(tokens) else 0
    s = np.full(len(x.of), top, np.int64)
    s[x.end] = top + 1 + np.arange(len(x.end))
    s[x.at] = tokens
    return suffix_classes(s, run)[x.windows]


def holders(x: Stream, cls: np.ndarray, content: np.ndarray) -> np.ndarray:
    """For each class the number of contents that hold it."""
    kinds, content = np.unique(content, return_inverse=True)
    n = max(len(kinds), 1)
    return np.bincount(np.unique(cls * n + content[x.of[x.windows]]) // n, minlength=len(x.of))


def window_hashes(x: Stream, hashes: np.ndarray, run: int) -> np.ndarray:
    """For each window of ``x`` a hash of its words, the same in every part."""
    s = np.full(len(x.of), 2 ** 64 - 1, np.uint64)
    s[x.at] = hashes
    out = np.zeros(len(x.windows), np.uint64)
    for i in range(run):
        out = W.mix(out + s[x.windows + i])
    return out


def needed(n_contents: int, p: PageParams) -> int:
    return max(p.least_pages, int(np.ceil(p.least_share * n_contents)))


def _words_under(x: Stream, hit: np.ndarray, run: int) -> np.ndarray:
    """For each word whether a window of ``hit`` (start places) covers it."""
    step = np.zeros(len(x.of) + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + run, -1)
    return np.cumsum(step)[:-1][x.at] > 0


def covered(tokens: np.ndarray, page: np.ndarray, n_pages: int, p: PageParams) -> np.ndarray:
    """For each token (values from 0, pages one after the other) whether a long
    substring that repeats across pages of different content covers it."""
    x = stream(page, n_pages, p.least_run)
    cls = classes(x, tokens, p.least_run)
    content = contents(x, W.mix(cls.astype(np.uint64)))
    often = holders(x, cls, content)[cls] >= needed(len(np.unique(content)), p)
    return _words_under(x, x.windows[often], p.least_run)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in W.small_batches(batches, "html"):
        texts, kinds = [], []
        for html in b.column("html"):
            t, k = blocks(html.as_py() or "")
            texts.append("\n".join(t))
            kinds.append(k)
        same = ["page_id", "url", "host", "part", "parts"]
        yield pa.record_batch([b.column(c) for c in same] + [pa.array(texts, pa.string()), pa.array(kinds, pa.string())], names=same + ["blocks", "kinds"])


def _split(t: pa.Table) -> tuple[W.Words, np.ndarray]:
    """Words of the pages of one part, and the page of each."""
    w = W.split_words(t.column("blocks").combine_chunks(), W.NON_SPACE)
    return w, w.row()


def _is_part(t: pa.Table) -> bool:
    """Whether ``t`` is one of several parts of its host."""
    return t.num_rows > 0 and t.column("parts")[0].as_py() > 1


def _rows_of(t: pa.Table, spec: str, values: np.ndarray, *more: np.ndarray) -> pa.Table:
    """``host``, [``part``,] the values (64 bits) and further numbers, for one part."""
    names = [c.split()[0] for c in spec.split(", ")]
    key = [pa.repeat(t.column(c)[0], len(values)) for c in names if c in ("host", "part")]
    return pa.table(key + [pa.array(v.view(np.int64) if v.dtype == np.uint64 else v.astype(np.int64)) for v in (values, *more)], names=names)


def _none(spec: str) -> pa.Table:
    return pa.table({c.split()[0]: pa.array([], pa.string() if c.endswith("string") else pa.int64()) for c in spec.split(", ")})


CONTENTS = "host string, part long, content long"
CANDIDATES = "host string, w long"
COUNTS = "host string, w long, n long"


def _hashed(t: pa.Table, p: PageParams) -> tuple[W.Words, Stream, np.ndarray]:
    """Words of the pages of one part, their stream and its window hashes."""
    w, page = _split(t)
    x = stream(page, t.num_rows, p.least_run)
    return w, x, window_hashes(x, w.hash, p.least_run)


def _contents(t: pa.Table, p: PageParams) -> pa.Table:
    """Distinct contents of one part of a host with several."""
    if not _is_part(t):
        return _none(CONTENTS)
    _, x, h = _hashed(t, p)
    return _rows_of(t, CONTENTS, np.unique(contents(x, h)))


def _leads(content: np.ndarray, home: np.ndarray) -> np.ndarray:
    """For each page whether it is the one that stands for a content at home in this part."""
    kinds, first = np.unique(content, return_index=True)
    lead = np.zeros(len(content), bool)
    lead[first[np.isin(kinds, home)]] = True
    return lead


def _uint(t: pa.Table, col: str) -> np.ndarray:
    return t.column(col).to_numpy().astype(np.int64).view(np.uint64)


def _candidates(t: pa.Table, homes: pa.Table, p: PageParams) -> pa.Table:
    """Long substrings that repeat often enough in this part for its share of
    the host's contents. One that repeats often enough in the host does so in
    some part, as each content is at home in one."""
    if not _is_part(t) or not homes.num_rows:
        return _none(CANDIDATES)
    w, x, h = _hashed(t, p)
    content = contents(x, h)
    lead = _leads(content, _uint(homes, "content"))
    h = h[lead[x.of[x.windows]]]
    own = lead[w.row()]
    x = stream((np.cumsum(lead) - 1)[w.row()[own]], int(lead.sum()), p.least_run)
    _, token = np.unique(w.hash[own], return_inverse=True)
    cls = classes(x, token.astype(np.int64), p.least_run)
    of_host = homes.column("contents")[0].as_py()
    often = holders(x, cls, content[lead])[cls] * of_host >= needed(of_host, p) * int(lead.sum())
    return _rows_of(t, CANDIDATES, np.unique(h[often]))


def _counts(t: pa.Table, asked: pa.Table, p: PageParams) -> pa.Table:
    """For each candidate of the host the contents at home in this part that hold it."""
    if not _is_part(t) or not asked.num_rows:
        return _none(COUNTS)
    values, is_content = _uint(asked, "value"), asked.column("is_content").to_numpy(zero_copy_only=False).astype(bool)
    _, x, h = _hashed(t, p)
    of = x.of[x.windows]
    own = _leads(contents(x, h), values[is_content])[of] & np.isin(h, values[~is_content])
    kinds, h = np.unique(h[own], return_inverse=True)
    pair = np.unique(h * t.num_rows + of[own])
    return _rows_of(t, COUNTS, kinds, np.bincount(pair // t.num_rows, minlength=len(kinds)))


def _keep_part(t: pa.Table, repeated: pa.Table, p: PageParams) -> pa.Table:
    """Main text of the pages of one part; ``repeated`` are the substrings that
    repeat in a host of several parts."""
    if not t.num_rows:
        return MAIN_SCHEMA.empty_table()
    return _keep(t, p, _uint(repeated, "w") if _is_part(t) else None)


def _keep(t: pa.Table, p: PageParams, repeated: np.ndarray | None = None) -> pa.Table:
    """Main text of the pages of one part; without ``repeated`` it is a whole host."""
    text = t.column("blocks").combine_chunks()
    kinds = t.column("kinds").to_pylist()
    raw, off = W.text_bytes(text)
    if repeated is None:
        w, page = _split(t)
        _, token = np.unique(w.hash, return_inverse=True)
        cover = covered(token.astype(np.int64), page, t.num_rows, p)
    else:
        w, x, h = _hashed(t, p)
        page = w.row()
        cover = _words_under(x, x.windows[np.isin(h, repeated)], p.least_run)
    # block of each word, over all pages
    lines = np.cumsum(raw == 0x0A)
    n_blocks = np.array([len(k) for k in kinds], np.int64)
    first = np.cumsum(n_blocks) - n_blocks
    before = np.concatenate([[0], lines])[off[:-1]] if len(kinds) else np.empty(0, np.int64)
    block = first[page] + lines[w.start] - before[page] if len(page) else np.empty(0, np.int64)
    total = int(n_blocks.sum())
    words = np.bincount(block, minlength=total)
    hit = np.bincount(block, weights=cover, minlength=total) >= p.cover * words
    out, chars, repeated, named = [], [], [], []
    for i, (s, k) in enumerate(zip(text.to_pylist(), kinds)):
        a = int(first[i])
        kept, r, c = [], 0, 0
        plain = not ("A" in k or "M" in k)   # nothing is named as the article
        for j, (line, kind) in enumerate(zip(s.split("\n"), k)):
            if kind == "A":
                kept.append(line)
            elif hit[a + j]:
                r += int(words[a + j])
            elif kind == "M" or kind == "U" and plain:
                kept.append(line)
            else:
                c += int(words[a + j])
        out.append("\n".join(kept))
        chars.append(len(out[-1]))
        repeated.append(r)
        named.append(c)
    ints = [pa.array(x, pa.int64()) for x in (chars, repeated, named)]
    return pa.table([t.column("page_id"), t.column("url"), pa.array(out, pa.string()), *ints], schema=MAIN_SCHEMA)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              params: PageParams = PageParams()) -> DataFrame:
    """One row per page: page_id, url, text (main blocks in page order, one per
    line), n_chars (code points), n_repeated (words dropped because a long
    substring repeats on other pages of the host) and n_named (words dropped
    because of what their markup says, or because they stand beside an article).

    Null or empty html gives an empty text; a null url is a host of its own, the
    empty one. Repeated rows and ids: each row is a page; rows of equal content
    are one content to the arrays, so copies alone make nothing boilerplate.
    Very long pages are read whole. An empty table has no rows. Other columns
    are not read. A host beyond ``part_bytes`` has several parts, pages dealt by
    a hash of id and url; its runs are counted over all its parts, so the result
    is the same for any ``part_bytes``. A run shorter than ``least_run`` words
    between unique words is not seen as repeated.
    """
    p = params
    url = pages[url_col].cast("string")
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), url.alias("url"), html.alias("html"), host_path(url)[0].alias("host"))
    # hosts beyond one part: fewer than bytes / part_bytes; they travel to the pages unless they are many
    big = written(rows.groupBy("host").agg(F.sum(F.octet_length("html").cast("long")).alias("b")).where(F.col("b") > p.part_bytes)
                  .select(F.col("host").alias("big"), F.ceil(F.col("b") / p.part_bytes).cast("long").alias("parts")), "big-hosts")
    n_big = big.limit(p.most_sent + 1).count()
    sent = F.broadcast if n_big <= p.most_sent else lambda df: df
    rows = rows.join(sent(big), rows["host"] == big["big"], "left").select(
        "page_id", "url", "host", "html", F.coalesce(F.col("parts"), F.lit(1).cast("long")).alias("parts")).select(
        "page_id", "url", "host", "html", "parts", F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).alias("part"))
    read = rows.mapInArrow(_read, "page_id long, url string, host string, part long, parts long, blocks string, kinds string")
    key = ("host", "part")
    if not n_big:
        return read.groupBy(*key).applyInArrow(lambda t: _keep(t, p), MAIN)
    # one query, so that the parts are shuffled once and read by each step
    homes = read.groupBy(*key).applyInArrow(lambda t: _contents(t, p), CONTENTS).groupBy("host", "content").agg(F.min("part").alias("part"))
    totals = homes.groupBy("host").agg(F.count("part").alias("contents"))  # of part, so that both uses share a shuffle
    of_host = homes.join(sent(totals), "host").select("host", "part", "content", "contents")
    found = read.groupBy(*key).cogroup(of_host.groupBy(*key)).applyInArrow(lambda t, h: _candidates(t, h, p), CANDIDATES).distinct()
    to_parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    asked = (found.join(sent(big), found["host"] == big["big"]).select("host", to_parts, F.col("w").alias("value"), F.lit(False).alias("is_content"))
             .unionByName(homes.select("host", "part", F.col("content").alias("value"), F.lit(True).alias("is_content"))))
    counted = (read.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(lambda t, a: _counts(t, a, p), COUNTS)
               .groupBy("host", "w").agg(F.sum("n").alias("n")))
    need = F.greatest(F.lit(p.least_pages), F.ceil(F.lit(p.least_share) * F.col("contents")).cast("long"))
    repeated = counted.join(sent(totals), "host").where(F.col("n") >= need).select("host", "w")
    repeated = repeated.join(sent(big), repeated["host"] == big["big"]).select("host", to_parts, "w")
    return read.groupBy(*key).cogroup(repeated.groupBy(*key)).applyInArrow(lambda t, r: _keep_part(t, r, p), MAIN)
