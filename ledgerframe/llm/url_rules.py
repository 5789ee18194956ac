"""URL filters whose block decisions reach a page's aliases.

Rules are (verdict, host, path): a rule fits its host and all subdomains, if the
url's path starts with the rule's; the longest rule wins, and of equally long
ones that with the longer host. Pages without a rule are judged through their
aliases: the addresses that canonical links and redirects connect, directly or
through others. If one of them is allowed by a rule, the page is allowed; else,
if one is blocked by a rule, it is blocked; else it is allowed. A page's own
rule always stands, so an explicit allow is never overridden by an alias.

Links come from the pages' markup (``<link rel="canonical">`` and
``<meta http-equiv="refresh">`` outside comments and scripts) and from a table
of (source, target) urls that a crawler observed, if there is one. An address is
host, path and query: scheme, port 80 or 443, and fragment make no difference.
Linked addresses that are no page count as aliases too, with the rules that fit
them. Components come from distributed label propagation; all of it is built-in
functions.

Edge cases: a url that is null or has no ``://`` has an empty host and path, no
rule, no aliases, and is allowed; user names before an ``@`` are part of the host,
as in the rules' definition; null or empty markup has no links; repeated pages and
urls share their fate and keep their rows; a link to itself or to something that
is no web address says nothing; an empty table gives an empty result. Only the
named columns are read and the result has its own, so other columns may have any
names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import cut

#: Up to so many rules are tried in one expression; more of them meet the urls in a join.
INLINE_RULES = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a browser does not read as markup; an open one reaches to the end.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea)\b.*?(?:</\1\b|\z)"
_TAG = r"(?i)<(?:link|meta)\b[^<>]*+>"


def _let(value, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts_of(url) -> Column:
    """(host, path, address) of a url.

    The host stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, with
    A-Z lower-cased; the path follows, up to ``?``, ``#`` or the end; both are empty
    without ``://``. The address is the host without a default port, the path and
    the query: equal for urls that lead to one place, empty without a host.
    """
    def read(rest) -> Column:
        host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
        return F.struct(host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1).alias("query"))

    def whole(p) -> Column:
        place = F.concat(F.regexp_replace(p["host"], r":(?:80|443)$", ""), F.when(p["path"] == "", "/").otherwise(p["path"]), p["query"])
        return F.struct(p["host"].alias("host"), p["path"].alias("path"), F.when(p["host"] == "", "").otherwise(place).alias("address"))

    at = F.instr(url, "://")
    return _let(_let(F.when(at > 0, F.substr(url, at + 3)).otherwise(""), read), whole)


def _fitting(host, path, rule_host, rule_path) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def _strength(rule_host, rule_path, verdict) -> Column:
    rule = F.concat(rule_host, rule_path)
    return F.struct(F.length(rule).alias("size"), F.length(rule_host).alias("host_size"), rule.alias("rule"), verdict.alias("verdict"))


def with_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]], inline: int = INLINE_RULES) -> DataFrame:
    """The rows of (id, host, path, ...) with ``rule`` and ``ruled``: the longest fitting rule and its verdict, or null."""
    if len(rules) <= inline:
        # the strongest first, so the first that fits wins
        ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1])), reverse=True)
        pick = lambda value: F.coalesce(*(F.when(_fitting(F.col("host"), F.col("path"), F.lit(r[1]), F.lit(r[2])), value(r)) for r in ordered), F.lit(None).cast("string"))
        return urls.select("*", pick(lambda r: F.lit(r[1] + r[2])).alias("rule"), pick(lambda r: F.lit(r[0])).alias("ruled"))
    listed = urls.sparkSession.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))
    hits = (
        urls.select("host", "path").where("host <> ''").distinct().withColumn("rule_host", F.explode(suffixes)).join(listed, "rule_host")
        .where(F.startswith("path", "rule_path"))
        .groupBy("host", "path").agg(F.max(_strength(F.col("rule_host"), F.col("rule_path"), F.col("verdict"))).alias("_best"))
    )
    return urls.join(hits, ["host", "path"], "left").select(*urls.columns, F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("ruled"))


def _attribute(tag, name: str) -> Column:
    """The value of an attribute of a tag, quoted or bare; empty if there is none."""
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.trim(F.replace(F.regexp_replace(found, r"^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&")), F.lit(" \t\r\n"))


def resolved(link, url) -> Column:
    """The absolute url of a link on a page; null if it is empty or leads to no web address."""
    def join(p) -> Column:
        scheme = F.substring_index(url, "://", 1)
        top = F.concat(scheme, F.lit("://"), p["host"])
        folder = F.regexp_extract(p["path"], r"(?s)^.*/", 0)
        return (
            F.when((link == "") | F.startswith(link, F.lit("#")) | (p["host"] == ""), None)
            .when(link.rlike(r"(?i)^https?://"), link)
            .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), None)
            .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
            .when(F.startswith(link, F.lit("/")), F.concat(top, link))
            .when(F.startswith(link, F.lit("?")), F.concat(top, p["path"], link))
            .otherwise(F.concat(top, F.when(folder == "", "/").otherwise(folder), link))
        )

    return _let(parts_of(url), join)


def markup_links(pages: DataFrame, url_col="url", html_col="html") -> DataFrame:
    """Rows of (source, target) urls: a page's canonical links and the redirects of its markup."""
    html, url = F.col(html_col).cast("string"), F.col(url_col).cast("string")
    tags = F.regexp_extract_all(F.regexp_replace(html, _HIDDEN, " "), F.lit(_TAG), F.lit(0))
    marked = r"(?i)^<(?:link\b.*canonical|meta\b.*refresh)"
    found = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select(url.alias("source"), F.explode(F.filter(tags, lambda t: t.rlike("(?s)" + marked))).alias("tag"))

    def link(tag) -> Column:
        canonical = tag.rlike(r"(?i)^<link\b") & F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
        refresh = tag.rlike(r"(?i)^<meta\b") & (F.lower(_attribute(tag, "http-equiv")) == "refresh")
        to = F.when(canonical, _attribute(tag, "href")).when(
            refresh, F.regexp_extract(_attribute(tag, "content"), r"(?is)^[\d.\s]*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"']*)", 1)
        )
        return F.trim(to, F.lit(" \t\r\n"))

    return found.select("source", _let(_let(F.col("tag"), link), lambda x: resolved(x, F.col("source"))).alias("target"))


def alias_groups(links: DataFrame) -> DataFrame:
    """Rows of (address, root) for all addresses that links of (source, target) connect."""
    address = lambda c: parts_of(F.col(c))["address"]
    edges = cut(links.where("target IS NOT NULL").select(address("source").alias("a"), address("target").alias("b")))
    return components(edges.where("a <> '' AND b <> ''")).select(F.col("node").alias("address"), "root")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col="page_id", url_col="url", html_col: str | None = "html", links: DataFrame | None = None) -> DataFrame:
    """Rows of (page_id, host, path, rule, verdict), one a page; ``verdict`` is the rule's or comes from the page's aliases."""
    url = F.col(url_col).cast("string")
    named = cut(pages.select(F.col(id_col).alias("page_id"), parts_of(url).alias("p")).select("page_id", "p.*"))
    judged = with_rules(named, rules)
    known = [] if links is None else [links.select("source", "target")]
    if html_col is not None:
        known.append(markup_links(pages, url_col, html_col))
    if not known:
        return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    groups = alias_groups(known[0] if len(known) == 1 else known[0].unionByName(known[1]))
    # an address is the text of a url without its scheme
    where = F.concat(F.lit("x://"), F.col("address"))
    ruled = with_rules(groups.select("address", "root", parts_of(where).alias("p")).select("address", "root", "p.host", "p.path"), rules)
    blocked = (
        ruled.groupBy("root").agg(F.count_if(F.col("ruled") == "allow").alias("allows"), F.count_if(F.col("ruled") == "block").alias("blocks"))
        .where("allows = 0 and blocks > 0").select("root")
    )
    fallen = cut(groups.join(blocked, "root", "left_semi").select("address", F.lit(True).alias("fallen")))
    # a page with a rule, or without an address, asks for nothing: its key is its own, and spread
    key = F.when(F.col("ruled").isNull() & (F.col("address") != ""), F.col("address")).otherwise(F.concat(F.lit("/"), F.xxhash64("page_id", "address").cast("string")))
    return judged.withColumn("address", key).join(fallen, "address", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("fallen"), "block"), F.lit("allow")).alias("verdict")
    )
