"""Main text of web pages by host suffix arrays (operator 1).

Every page is cut into blocks of text, each with what its markup says: inside the article, inside a menu,
header, footer, sidebar, notice, advert or reader comment, or neither. Scripts, styles, forms and markup
give no blocks. The token streams of a host's pages, blocks of a kind together, are concatenated, with a mark
of its own after each stream, into a suffix array. Runs of at least ``MIN_TOKENS`` tokens found on
``MIN_PAGES`` pages of different content are repeated; as a longer run is covered by its parts of
``MIN_TOKENS``, the order of the suffixes need not be known any deeper.

A block goes when the markup calls it boilerplate. Of the others repeats decide: outside of an article a
block goes when repeated runs cover most of it, whether the page has an article or not; inside of one, when
the runs that cover most of it are on ``WIDE_SHARE`` of the host's different pages and on ``WIDE_PAGES`` at
least. Other repeats inside an article are counted but stay: articles quote one another and are copied
whole, and the text of an article has to come out whole. How many blocks went by markup and by repeats is
told for each page.

A host of more than ``ARRAY_PAGES`` pages gets several arrays, its pages dealt by a hash of page_id and url. What
stands outside of articles is counted over the whole host all the same: the runs of ``MIN_TOKENS`` tokens of
all its pages are added up by digest, and each array is told which of its pages' runs are repeated. Which
runs inside articles are on ``WIDE_SHARE`` of the pages is seen from an array's own pages, as is the number of
repeated tokens inside articles. No page is left out and no text shortened.

A null or empty html gives an empty text; a null url belongs to a host of its own; page_id may be null and
may repeat, every row is extracted; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, maybe_broadcast, stored

MIN_TOKENS, MIN_PAGES = 5, 3
#: Pages of one suffix array on average; memory of a task grows with their text alone.
ARRAY_PAGES = 128
#: Share of a block's tokens that repeated runs must cover.
COVERED = 0.5
#: Share of a host's contents, and how many of them at least, that runs of a block inside an article must be on.
WIDE_SHARE, WIDE_PAGES = 0.5, 10

MAIN, BOILERPLATE, PLAIN = 0, 1, 2

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)()[^>]*(?:>|\Z)", re.S)
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
MARK_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements by what HTML and common practice use them for.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select datalist".split())
FORM = frozenset("form button fieldset label input option".split())
AROUND = frozenset("nav footer aside menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HOLDERS = frozenset("html body div section article main header ul ol dl table tbody thead tfoot tr figure details blockquote center".split()) | AROUND | FORM
BOILERPLATE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription social share sharing related recommended recommendations sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead comment comments disqus reply replies discussion toolbar pagination pager login signup search complementary contentinfo".split()
)
PAGE_HEADER_WORDS = frozenset(["header", "topbar"])


def _marks(attributes: str) -> set[str]:
    words: set[str] = set()
    for m in MARKS.finditer(attributes):
        words.update(w.lower() for w in MARK_WORD.findall(m.group(1) or m.group(2) or m.group(3) or ""))
    return words


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(role, text) of each block in page order; texts are decoded, trimmed and single-spaced."""
    if not html:
        return []
    out: list[tuple[int, str]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int | None, bool]] = []  # element, role it gives, whether its text is dropped
    role, dropped = PLAIN, False

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                out.append((role, text))
            buffer.clear()

    def look() -> None:
        nonlocal role, dropped
        given = [r for _, r, _ in stack if r is not None]
        role = BOILERPLATE if BOILERPLATE in given else MAIN if MAIN in given else PLAIN
        dropped = any(d for _, _, d in stack)

    at, size = 0, len(html)
    while at < size:
        m = TAG.search(html, at)
        if m is None or m.start() > at:
            text = html[at : m.start() if m else size]
            if not dropped:
                buffer.append(unescape(text) if "&" in text else text)
            if m is None:
                break
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        closing = m.group(1) or m.group(4)
        if name == "br":
            buffer.append("\n")
            continue
        if name not in INLINE:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush()
                    del stack[k:]
                    look()
                    break
            continue
        attributes = m.group(3) or ""
        if name in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else size
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name not in INLINE and stack and stack[-1][0] in ("p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"):
            stack.pop()  # these end where the next block begins
            look()
        words = _marks(attributes) if attributes else set()
        gives: int | None = None
        if name in ("article", "main") or "main" in words and role != MAIN:
            gives = MAIN
        if name in AROUND or words & BOILERPLATE_WORDS or role != MAIN and (name == "header" or words & PAGE_HEADER_WORDS):
            gives = BOILERPLATE if name not in ("html", "body", "article", "main") else gives
        drop = name in FORM or name == "head"
        if gives is not None or drop or name in HOLDERS:
            if gives is not None or drop:
                flush()
            stack.append((name, gives, drop))
            if gives is not None or drop:
                look()
    flush()
    return out


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``depth`` tokens (a power of two) at least, and how many tokens each shares with the next, counted up to twice ``depth`` less one."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    levels, size = [rank], 1
    while size < depth:
        after = np.zeros(n, np.int64)
        after[: max(n - size, 0)] = rank[size:]
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        levels.append(rank)
        size *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) + (1 << k) <= n
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = same.astype(np.int64) << k
        a, b, shared = a + step, b + step, shared + step
    return order, shared


def repeated(tokens: np.ndarray, content: np.ndarray, *least: int) -> list[np.ndarray]:
    """Which tokens lie in runs on at least so many contents, for each of ``least``; ``content`` numbers the content of each token's page."""
    n = len(tokens)
    if n < MIN_TOKENS:
        return [np.zeros(n, bool) for _ in least]
    order, shared = suffix_array(tokens, 1 << (MIN_TOKENS - 1).bit_length())
    group = np.concatenate(([0], np.cumsum(shared < MIN_TOKENS)))
    pages = np.unique(np.column_stack([group, content[order]]), axis=0)[:, 0]
    several = np.bincount(pages, minlength=group[-1] + 1)[group]
    out = []
    for k in least:
        out.append(_spread(order[several >= k], n))
    return out


def digests(words: list[str]) -> np.ndarray:
    """Digests of the runs of MIN_TOKENS words."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    out = np.zeros(max(len(h) - MIN_TOKENS + 1, 0), np.uint64)
    for k in range(MIN_TOKENS):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _spread(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n tokens lie in runs of MIN_TOKENS that begin at ``starts``."""
    edge = np.zeros(n + MIN_TOKENS + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + MIN_TOKENS, -1)
    return np.cumsum(edge)[:n] > 0


def main_texts(pages: list[list[tuple[int, str]]], told: list[set[int] | None]) -> list[tuple[str, int, int, int]]:
    """For the blocks of pages of one host: the main text of each, how many tokens of its other blocks and its article are repeated, and how many blocks went by markup and by repeats.

    ``told``: of each page the digests of runs outside of articles that are repeated; None: the pages here are
    all of the host, and its suffix array says which are.
    """
    words: list[str] = []
    page_of, block_of, role_of = [], [], []
    n_blocks = 0
    contents: dict[int, int] = {}
    for page in pages:
        content = contents.setdefault(hash(tuple(page)), len(contents))
        for kind in (MAIN, PLAIN):
            for k, (role, text) in enumerate(page):
                if role == kind:
                    split = text.split()
                    words += split
                    page_of += [content] * len(split)
                    block_of += [n_blocks + k] * len(split)
                    role_of += [kind] * len(split)
            words.append("")  # made different for every stream below
            page_of.append(content)
            block_of.append(-1)
            role_of.append(kind)
        n_blocks += len(page)
    block, role = np.array(block_of, np.int64), np.array(role_of, np.int64)
    tokens = pd.factorize(np.array(words, object))[0].astype(np.int64) * 3 + role  # what is inside and outside of articles is not alike
    marks = np.flatnonzero(block < 0)
    tokens[marks] = tokens.max(initial=0) + 1 + np.arange(len(marks))
    covered, wide = repeated(tokens, np.array(page_of, np.int64), MIN_PAGES, max(WIDE_PAGES, int(np.ceil(WIDE_SHARE * len(contents)))))
    at = 0
    for page, known in zip(pages, told, strict=True):
        sizes = [sum(len(t.split()) for r, t in page if r == kind) for kind in (MAIN, PLAIN)]
        first = at + sizes[0] + 1
        if known is not None and sizes[1]:
            runs = digests(words[first : first + sizes[1]])
            covered[first : first + sizes[1]] = _spread(np.flatnonzero([int(x) in known for x in runs]), sizes[1])
        at = first + sizes[1] + 1
    inside = block >= 0
    total = np.bincount(block[inside], minlength=n_blocks)
    share, wide_share = (np.bincount(block[inside], weights=x[inside], minlength=n_blocks) / np.maximum(total, 1) for x in (covered, wide))
    out, k = [], 0
    for page in pages:
        kept, n_repeated, by_markup, by_repeats = [], 0, 0, 0
        for role, text in page:
            n_repeated += round(share[k] * total[k])
            if role == BOILERPLATE:
                by_markup += 1
            elif (wide_share if role == MAIN else share)[k] < COVERED:
                kept.append(text)
            else:
                by_repeats += 1
            k += 1
        out.append(("\n\n".join(kept), n_repeated, by_markup, by_repeats))
    return out


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Roles and texts of the blocks; of what the markup calls boilerplate the roles alone."""
    for pdf in batches:
        got = [blocks(x) for x in pdf["html"]]
        yield pdf.drop(columns="html").assign(roles=[[r for r, _ in b] for b in got], texts=[[t if r != BOILERPLATE else "" for r, t in b] for b in got])


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digests of each page's runs outside of its article, and one of the page's content."""
    for pdf in batches:
        for host, part, uid, html in zip(pdf["host"], pdf["part"], pdf["uid"], pdf["html"], strict=True):
            page = blocks(html)
            found = np.unique(digests([w for r, t in page if r == PLAIN for w in t.split()]))
            if len(found):
                content = xxhash.xxh3_64_intdigest("\0".join(f"{r}{t if r != BOILERPLATE else ''}" for r, t in page).encode("utf-8", "surrogatepass")) >> 1
                yield pd.DataFrame({"host": host, "part": part, "uid": uid, "digest": found, "content": content})


def _extract(pdf: pd.DataFrame, repeats: pd.DataFrame) -> pd.DataFrame:
    if not len(pdf):
        return pd.DataFrame({"page_id": pd.Series(dtype="Int64"), "url": [], "text": [], "n_chars": [], "n_repeated_tokens": [], "n_blocks_by_markup": [], "n_blocks_by_repeats": []})
    pdf = pdf.sort_values(["page_id", "url", "uid"], kind="stable")
    known = dict(zip(repeats["uid"].tolist(), repeats["digests"], strict=True))
    told = [set(map(int, known.get(uid, ()))) if arrays > 1 else None for uid, arrays in zip(pdf["uid"].tolist(), pdf["arrays"], strict=True)]
    got = main_texts([list(zip([int(r) for r in roles], texts, strict=True)) for roles, texts in zip(pdf["roles"], pdf["texts"], strict=True)], told)
    columns = dict(zip(("text", "n_repeated_tokens", "n_blocks_by_markup", "n_blocks_by_repeats"), zip(*got, strict=True), strict=True))
    return pd.DataFrame({"page_id": pdf["page_id"].astype("Int64").array, "url": pdf["url"].array, "text": columns.pop("text"), "n_chars": [len(t) for t, *_ in got]} | columns)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated_tokens, n_blocks_by_markup, n_blocks_by_repeats for every row of ``pages(page_id, url, html)``."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("uid"))
    # Only hosts that need several arrays are listed.
    large = stored(rows.groupBy("host").count().where(F.col("count") > ARRAY_PAGES).select("host", F.ceil(F.col("count") / ARRAY_PAGES).alias("arrays")), "hosts")
    dealt = rows.join(maybe_broadcast(large), "host", "left").withColumn("arrays", F.coalesce("arrays", F.lit(1).cast("long"))).withColumn("part", F.pmod(F.xxhash64("page_id", "url"), "arrays"))
    runs = stored(dealt.where("arrays > 1").select("host", "part", "uid", "html").mapInPandas(_runs, "host string, part long, uid long, digest long, content long"), "host-runs")
    # Rows that are alike have one uid, and the same runs. Runs of different contents are counted, not gathered; a run of very many pages is one row of each content and task.
    often = stored(runs.select("host", "digest", "content").distinct().groupBy("host", "digest").count().where(F.col("count") >= MIN_PAGES).select("host", "digest"), "host-repeats")
    repeats = runs.join(often, ["host", "digest"]).groupBy("host", "part", "uid").agg(F.collect_set("digest").alias("digests"))
    cut = dealt.select("page_id", "url", "html", "host", "uid", "arrays", "part").mapInPandas(_cut, "page_id long, url string, host string, uid long, arrays long, part long, roles array<int>, texts array<string>")
    out = "page_id long, url string, text string, n_chars long, n_repeated_tokens long, n_blocks_by_markup long, n_blocks_by_repeats long"
    return cut.groupBy("host", "part").cogroup(repeats.groupBy("host", "part")).applyInPandas(_extract, out)
