"""Main text of web pages: structure first, then a host suffix array for what it leaves open.

A page is read as blocks. Blocks inside its article are the text; blocks inside
menus, headers, footers, sidebars, notices, adverts, forms and reader comments
are not. Blocks that structure leaves open (outside any article, in no such
element) are judged by the host suffix array: the words of all blocks outside
articles are concatenated per page, suffixes of a host's streams are sorted to
a depth of ``LENGTH`` words, and every word under a string of ``LENGTH`` or more
words that occurs on two distinct pages is boilerplate. Covered words of open
blocks are removed, unique runs stay.

Text inside an article is never judged by repetition: whole articles are
reprinted across pages, and the article is to be kept whole.

The suffix arrays are built per host and anchor (see ``anchors``), after equal
contexts have been collapsed to one row each. A host has as many parts as its
words need; anchors with very many different contexts are counted window by
window instead, without groups, so no host or anchor makes a large group.

Edge cases: null html has no text; null urls share the host ""; unclosed and
truncated elements end with the page; pages that are equal in all columns count
as one page; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchored_runs
from .common import cut

#: Words of a string that counts as repeated, and of the pieces that anchor it.
LENGTH, GRAM = 8, 2
#: An anchor with more different contexts than this is counted by windows.
HOT_CONTEXTS = 2_000
#: Parts of a host, and the mean words a part from which a host gets more of them.
PARTS, PART_WORDS = 64, 200_000

# Element names by role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select xmp".split())
OUTSIDE = frozenset("nav aside footer form button dialog menu head label input fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACES = frozenset("br hr td th img".split())
ENDS_ITSELF = frozenset("p li dt dd option tr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices notification "
    "newsletter subscribe subscription popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus respond reply replies "
    "social share sharing related recommended recommendations teaser teasers widget toolbar pagination pager login signup search skip alert".split()
)
SIDE_ARTICLES = frozenset("comment comments reply replies teaser teasers related recommended advert advertisement sponsored".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z:_-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    if name in OUTSIDE or name == "header" and not in_article:
        return True
    if not attributes:
        return False
    # A page's own article may bear any layout's name; comments and teasers are articles too, mostly inside it.
    marks = MARKS if in_article or name not in ("html", "body", "article", "main") else SIDE_ARTICLES if name == "article" else frozenset()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and not marks.isdisjoint(re.split(r"[\s_-]+", value)):
            return True
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _is_article(name: str, attributes: str) -> bool:
    return name in ("article", "main") or bool(attributes) and re.search(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody\b", attributes, re.I) is not None


def page_blocks(page: str) -> tuple[list[str], list[tuple[str, bool]]]:
    """Blocks inside articles; and the others with whether structure leaves them open."""
    inner: list[str] = []
    outer: list[tuple[str, bool]] = []
    parts: list[str] = []
    article, article_depth, out, out_depth = "", 0, "", 0

    def flush() -> None:
        text = "".join(parts)
        parts.clear()
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if text:
            if article and not out:
                inner.append(text)
            else:
                outer.append((text, not out and not article))

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        closing, name, attributes = m[1], m[2].lower(), m[3]
        if not closing and name in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            parts.append(" ")
            continue
        if name in SPACES:
            parts.append(" ")
        if name not in BLOCKS and name not in OUTSIDE and not (not closing and _boilerplate(name, attributes, bool(article))) and name != out and name != article:
            continue
        if name in VOID:
            continue
        flush()
        if out:
            if out in ENDS_ITSELF and name in BLOCKS and (name != out or not closing):
                out = ""
            elif name == out:
                out_depth += -1 if closing else 1
                if not out_depth:
                    out = ""
                continue
            elif closing and article and name == article and article_depth == 1:
                out = ""
            else:
                continue
        if article and name == article and (closing or not _boilerplate(name, attributes, True)):
            article_depth += -1 if closing else 1
            if not article_depth:
                article = ""
            continue
        if closing:
            continue
        aside = _boilerplate(name, attributes, bool(article))
        if _is_article(name, attributes) and not article and not (aside and name == "article"):
            article, article_depth = name, 1
        elif aside:
            out, out_depth = name, 1
    flush()
    return inner, outer


def _parsed(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [page_blocks(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key"), "page_id": batch.column("page_id"), "url": batch.column("url"), "host": batch.column("host"),
                "inner": pa.array(["\n".join(i) for i, _ in rows], pa.string()),
                "outer": pa.array([[t for t, _ in o] if not i else [] for i, o in rows], pa.list_(pa.string())),
                "open": pa.array([[x for _, x in o] if not i else [] for i, o in rows], pa.list_(pa.bool_())),
                "article": pa.array([bool(i) for i, _ in rows]),
            })

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"key long, page_id {kind}, url string, host string, inner string, outer array<string>, open array<boolean>, article boolean")


def _contexts(pages: DataFrame, words: bool) -> DataFrame:
    """Anchored contexts of the word streams outside articles: their words, or where they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = [[xxhash.xxh64_intdigest(w) for text, _ in page_blocks(x)[1] for w in text.split()] for x in batch.column("html").to_pylist()]
            bounds = np.concatenate(([0], np.cumsum([len(s) for s in streams]))).astype(np.int64)
            symbols = np.array([w for s in streams for w in s], dtype=np.uint64)
            owner, starts, counts, keys = anchored_runs(symbols, bounds, GRAM, LENGTH)
            flat = symbols.view(np.int64)
            contexts = [flat[a : a + n + LENGTH - 1] for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]
            hashes = np.array([xxhash.xxh64_intdigest(c.tobytes()) for c in contexts], dtype=np.uint64)
            made = {
                "host": batch.column("host").take(pa.array(owner)), "anchor": keys.view(np.int64), "hash": hashes.view(np.int64), "key": batch.column("key").take(pa.array(owner)),
            }
            if words:
                sizes = np.array([len(c) for c in contexts], dtype=np.int64)
                made["context"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(contexts) if contexts else flat[:0]))
            else:
                made |= {"start": (starts - bounds[owner]).astype(np.int32), "windows": counts.astype(np.int32)}
            yield pa.RecordBatch.from_pydict(made)

    return pages.mapInArrow(run, "host string, anchor long, hash long, key long, " + ("context array<long>" if words else "start int, windows int"))


def repeated_windows(contexts: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> list[list[int]]:
    """Per context the windows of ``LENGTH`` words that occur on two distinct pages.

    The suffixes of all contexts, end to end with unequal ends between them, are
    ranked by prefix doubling to a depth of ``LENGTH``: equal ranks are equal windows.
    """
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    text = np.concatenate(contexts)
    _, rank = np.unique(text, return_inverse=True)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    room = np.repeat(starts + sizes, sizes) - np.arange(len(text))
    depth = 1
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        ahead = np.full(len(text), -1, dtype=np.int64)
        ahead[:-step] = rank[step:]
        ahead[room <= step] = -1
        order = np.lexsort((ahead, rank))
        changed = np.concatenate(([True], (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])))
        rank = np.empty(len(text), dtype=np.int64)
        rank[order] = np.cumsum(changed) - 1
        depth += step
    whole = np.flatnonzero(room >= LENGTH)
    kinds = int(rank.max()) + 1
    low, high = np.full(kinds, np.iinfo(np.int64).max), np.full(kinds, np.iinfo(np.int64).min)
    np.minimum.at(low, rank[whole], first[owner[whole]])
    np.maximum.at(high, rank[whole], last[owner[whole]])
    hit = whole[low[rank[whole]] < high[rank[whole]]]
    found: list[list[int]] = [[] for _ in contexts]
    for c, at in zip(owner[hit].tolist(), (hit - starts[owner[hit]]).tolist(), strict=True):
        found[c].append(at)
    return found


def _suffix_arrays(group: pd.DataFrame) -> pd.DataFrame:
    found = repeated_windows([np.asarray(c, dtype=np.int64) for c in group["context"]], group["first"].to_numpy(), group["last"].to_numpy())
    out = group[["host", "hash", "nth"]].assign(repeated=found)
    return out[[bool(f) for f in found]]


def in_parts(contexts: DataFrame) -> DataFrame:
    """Contexts with the part of their host; only hosts beyond ``PARTS`` parts of ``PART_WORDS`` words, a few by their size, are listed."""
    words = contexts.groupBy("host").agg(F.sum(F.size("context")).alias("words")).where(F.col("words") > PARTS * PART_WORDS)
    large = words.select("host", F.ceil(F.col("words") / PART_WORDS).alias("parts"))
    return contexts.join(F.broadcast(large), "host", "left").withColumn("part", F.pmod(F.xxhash64("deal"), F.coalesce("parts", F.lit(PARTS)))).drop("parts")


def covered_words(pages: DataFrame) -> DataFrame:
    """Rows of (key, covered): positions of the page's words, outside articles, under repeated strings."""
    # Five branches read the distinct contexts: behind a checkpoint, pages are parsed for them once.
    distinct = cut(
        _contexts(pages, words=True).groupBy("host", "anchor", "hash")
        .agg(F.min("key").alias("first"), F.max("key").alias("last"), F.any_value("context").alias("context"))
    )
    hot = distinct.groupBy("host", "anchor").count().where(F.col("count") > HOT_CONTEXTS).select("host", "anchor", F.lit(True).alias("is_hot"))
    dealt = distinct.join(hot, ["host", "anchor"], "left")
    windows = F.transform(F.sequence(F.lit(1), F.size("context") - LENGTH + 1), lambda i: F.slice("context", i, F.lit(LENGTH)))
    cool = dealt.where(F.col("is_hot").isNull()).select("host", F.col("anchor").alias("deal"), "hash", F.lit(0).alias("nth"), "context", "first", "last")
    single = dealt.where("is_hot").select("host", "hash", "first", "last", F.posexplode(windows).alias("nth", "context"))
    lowest = single.groupBy("host", F.xxhash64("context").alias("deal")).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    # Every row of a window knows all of the window's pages already.
    warm = (
        single.select("host", F.xxhash64("context").alias("deal"), "hash", "nth").join(lowest.where("first < last"), ["host", "deal"])
        .select("host", "hash", "nth", F.array(F.lit(0)).alias("repeated"))
    )
    cooled = in_parts(cool).groupBy("host", "part").applyInPandas(_suffix_arrays, "host string, hash long, nth int, repeated array<int>")
    repeated = cooled.unionByName(warm)
    by_context = repeated.groupBy("host", "hash").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("repeated", lambda w: w + F.col("nth"))))).alias("repeated"))
    spots = F.flatten(F.transform("repeated", lambda w: F.sequence(F.col("start") + w, F.col("start") + w + LENGTH - 1)))
    return (
        _contexts(pages, words=False).join(by_context, ["host", "hash"]).select("key", spots.alias("spots"))
        .groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("spots"))).alias("covered"))
    )


def _unique_runs(outer, is_open, covered):
    """Open blocks without their covered words."""
    gone, kept, at = set(covered or ()), [], 0
    for text, free in zip(outer, is_open, strict=True):
        words = text.split()
        if free and (left := [w for i, w in enumerate(words, at) if i not in gone]):
            kept.append(" ".join(left))
        at += len(words)
    return kept


def main_text(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Rows of (page_id, url, text, boilerplate_words): words outside articles that the host repeats."""
    whole = pages.select(
        F.xxhash64(id_col, url_col, html_col).alias("key"), F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.lower(F.coalesce(F.regexp_extract(url_col, _HOST, 1), F.lit(""))).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    judged = _parsed(whole).join(covered_words(whole), "key", "left")
    open_text = F.array_join(F.udf(_unique_runs, "array<string>")("outer", "open", "covered"), "\n")
    return judged.select(
        "page_id", "url", F.when(F.col("article"), F.col("inner")).when(~F.exists("open", lambda x: x), F.lit("")).otherwise(open_text).alias("text"),
        F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).alias("boilerplate_words"),
    )
