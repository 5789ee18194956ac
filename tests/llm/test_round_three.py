"""Url rules, phrase mining and the prefix trie against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import phrase_mining, prefix_trie, url_rules, word_index
from ledgerframe.llm.queries import URL_RULES

CLASHES = ("host", "path", "rule", "verdict", "lang2", "key", "depth", "bucket", "phrase", "address", "root", "pos", "first", "n")


def clashing(df, but=()):
    return df.withColumns({c: F.lit(1) for c in CLASHES if c not in but})


# --- word index and phrases


def plain_pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", p))]


def plain_phrases(rows, min_count, max_words, cover, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in plain_pieces(text):
            n[lang or "und"] += len(piece)
            for m in range(1, max_words + 1):
                f.update((lang or "und", tuple(piece[i : i + m])) for i in range(len(piece) - m + 1))
    found = defaultdict(list)
    cands = {k: a for k, a in f.items() if a >= min_count and len(k[1]) > 1}
    inside = defaultdict(int)
    for (lang, w), a in cands.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i : i + m]] = max(inside[lang, w[i : i + m]], a)
    for (lang, w), a in cands.items():
        if (lang, w) in inside and 100 * inside[lang, w] >= cover * a:
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        found[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {
        (lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)
    }


def test_words_of_cuts_like_the_definition():
    texts = ["", "  ", "One two,THREE\x0bfour\tfive", "É x y", "no-end", ".lead", "a", "b c"]
    words, piece = word_index.words_of(pa.array(texts, pa.large_string()))
    found = defaultdict(list)
    for w, p in zip(words.to_pylist(), piece.tolist(), strict=True):
        found[p].append(w)
    assert list(found.values()) == [p for t in texts for p in plain_pieces(t)]


@pytest.mark.parametrize("seed", range(6))
def test_levels_count_all_phrases(seed):
    rng = random.Random(seed)
    pieces = [[rng.randrange(2 + seed) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 40))]
    _, ids = np.unique([i for p in pieces for i in p], return_inverse=True)
    piece = np.array([k * 3 for k, p in enumerate(pieces) for _ in p])
    split = np.split(ids, np.flatnonzero(np.diff(piece)) + 1)
    before = None
    for m, level in enumerate(word_index.levels(ids.astype(np.int32), piece, 4), 1):
        want = Counter(tuple(p[i : i + m].tolist()) for p in split for i in range(len(p) - m + 1))
        got = list(zip(*(w.tolist() for w in level.words), strict=True))
        assert dict(zip(got, level.count.tolist(), strict=True)) == want and len(got) == len(want)
        if before is not None:  # what an extension adds on the left and on the right
            assert [before[k] for k in level.rest] == [g[1:] for g in got] and [before[k] for k in level.stem] == [g[:-1] for g in got]
        before = got


@pytest.mark.parametrize(("shard", "bucket"), [(16 << 20, 8 << 20), (300, 200)])
def test_phrases_against_plain_loop(spark, monkeypatch, shard, bucket):
    monkeypatch.setattr(phrase_mining, "SHARD_BYTES", shard)
    monkeypatch.setattr(phrase_mining, "BUCKET_BYTES", bucket)
    rng = random.Random(3)
    words = ["Ab", "ab", "c", "d.e", "f,", "gé", "h i", "x", "x", "x"]
    rows = [(rng.choice(["en", "en", "fr", None]), " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for _ in range(120)]
    rows += [("en", None), (None, ""), ("de", " \n "), ("en", "y y z " * 500), ("und", "x x")] + [("en", "same old song")] * 12
    df = clashing(spark.createDataFrame(rows, "lang string, text string").repartition(5))
    got = phrase_mining.mine_phrases(df, min_count=4, cover=60, top=25)
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.select(cols).collect()} == plain_phrases(rows, 4, 3, 60, 25)
    four = phrase_mining.mine_phrases(df, min_count=3, max_words=4, cover=101, top=10**6)
    assert {tuple(r) for r in four.select(cols).collect()} == plain_phrases(rows, 3, 4, 101, 10**6)
    assert phrase_mining.mine_phrases(df.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a = 10**14 + 7
    counts = spark.createDataFrame([("en", 1, "a", a + 3), ("en", 1, "b", a + 1), ("en", 2, "a b", a), ("en", 0, None, 9 * a)], "lang string, words int, phrase string, f long")
    row = phrase_mining.score_phrases(counts).first()
    assert row.score == 1000000 * a * a // ((a + 3) * (a + 1))


# --- prefix trie


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    turns = {c: [t for *_, t in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seq = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    out = set()
    for node, inside in members.items():
        below = [m for m in members if m[: len(node)] == node]
        out.add((
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), sum(len(m) == len(node) + 1 for m in below),
            sum(not any(len(x) == len(m) + 1 and x[:-1] == m for x in members) for m in below),
            sum((len(members[m]) - 1) * (len(m[-1][1]) if m else 0) for m in below), hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        ))
    return out


def test_trie_against_plain_loop(spark):
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 60), *range(195, 230), -5, -105, 10**12, 10**12 + 3]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes é\U0001F600", "", None, f"own {c}"])))
    rows += [(7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, None, "user", "first"), (None, 1, "user", "no conversation")]
    rows += [(300 + k, t, "user", "copy") for k in range(99) for t in range(7)] + [(500, t, "user", "long " * 50) for t in range(400)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6))
    got = [tuple(r) for r in prefix_trie.prefix_trie(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


def test_end_lists_do_not_depend_on_runs(spark, monkeypatch):
    ends = spark.range(-50, 350).select(F.col("id").alias("conv_id"), F.lit(b"k").alias("key"))
    whole = prefix_trie.end_lists(ends).first()
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    assert prefix_trie.end_lists(ends).first() == whole
    assert whole.ends_sha256 == hashlib.sha256(",".join(map(str, range(-50, 350))).encode()).hexdigest()


# --- url rules


def page(k, url, head="", body=""):
    return (k, url, None if head is None else f"<html><head>{head}</head><body>{body}</body></html>")


PAGES = [
    page(1, "https://x.net/a", '<link rel="canonical" href="https://www.example.org/es/p">'),  # by a blocked address that is no page
    page(2, "http://y.net/b?q=1#top", "<META content='0; url=//X.net/a' http-equiv=refresh>"),  # through page 1
    page(3, "https://good.com/fr/c", '<link rel="canonical" href="https://x.net/a">'),  # allowed by its own rule, and frees its aliases
    page(4, "https://z.net/d", '<link rel="alternate canonical" href="https://shop.com/de/1?a=1&amp;b=2">'),
    page(5, "https://z.net/e/f.html", '<link href=../e rel=canonical><link rel=canonical href=g>'),
    page(6, "https://z.net:443/e/g", '<link rel="canonical" href="/d">'),
    page(7, "https://w.net/", '<!-- <link rel="canonical" href="https://shop.com/de/1"> --><script>"<link rel=canonical href=https://shop.com/de/1>"</script>'),
    page(8, "https://w.net/self", '<link rel="canonical" href="#x"><link rel="canonical" href="mailto:a@b"><link rel=stylesheet href="https://shop.com/de/1">'),
    page(9, "https://EXAMPLE.org/en/15", '<link rel="canonical" href="https://ok.org/en/15">'),
    page(10, None, '<link rel="canonical" href="https://shop.com/de/1">'), page(11, "no scheme/de/"), page(12, "", None), page(13, "https://shop.com/de?x=/de/", None),
    page(14, "https://notexample.org/es/1"), page(15, "ftp://a.b.com/fr/", None), page(15, "ftp://a.b.com/fr/", None), page(None, "https://z.net/d", None), page(16, "https://u.net", "<!-- open <link rel=canonical href=https://shop.com/de/1>"),
    page(17, "https://long.net/" + "p" * 50000, None, ), page(18, "https://v.net/x", '<link rel="canonical" href="https://v.net/x">' + "<link " * 5000),
]


def test_url_rules_and_aliases(spark):
    df = clashing(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3))
    got = sorted((r.page_id or 0, r.host, r.path[:20], r.rule, r.verdict) for r in url_rules.judge_urls(df, URL_RULES).collect())
    verdicts = {k: v for k, *_, v in got}
    assert len(got) == len(PAGES)
    assert (1, "x.net", "/a", None, "allow") in got and verdicts[2] == "allow" and (3, "good.com", "/fr/c", "com/fr/", "allow") in got
    assert [verdicts[k] for k in (4, 5, 6, 0)] == ["block"] * 4 and [verdicts[k] for k in (7, 8, 10, 11, 12, 13, 16, 17, 18)] == ["allow"] * 9
    assert (9, "example.org", "/en/15", "example.org/en/1", "block") in got and (14, "notexample.org", "/es/1", "org/", "allow") in got
    assert [g for g in got if g[0] in (10, 11, 12)] == [(k, "", "", None, "allow") for k in (10, 11, 12)]
    without = url_rules.judge_urls(df.where("page_id <> 3"), URL_RULES)
    assert {r.page_id: r.verdict for r in without.collect()} | {1: "block", 2: "block"} == {r.page_id: r.verdict for r in without.collect()}
    assert url_rules.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_redirects_that_a_crawler_saw(spark):
    df = spark.createDataFrame([(k, f"http://h{k}.net/") for k in range(40)], "page_id long, url string")
    seen = spark.createDataFrame([(f"http://h{k}.net", f"https://h{k + 1}.net/") for k in range(0, 19)] + [("http://h19.net/", "http://bad.com/de/"), (None, "http://bad.com/de/")], "source string, target string")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(df, URL_RULES, html_col=None, links=seen).collect()}
    assert got == {k: "block" if k < 20 else "allow" for k in range(40)}
    assert {r.verdict for r in url_rules.judge_urls(df, URL_RULES, html_col=None).collect()} == {"allow"}


def test_many_rules_meet_in_a_join(spark):
    rng = random.Random(2)
    hosts = ["a.com", "b.a.com", "com", "x.b.a.com", "org", ""]
    rules = sorted({(rng.choice(["allow", "block"]), rng.choice(hosts[:5]), rng.choice(["/", "/p", "/p/q", "/z"])) for _ in range(30)}, key=lambda r: r[1:])
    rules = [r for i, r in enumerate(rules) if not i or rules[i - 1][1:] != r[1:]]
    urls = spark.createDataFrame([(i, rng.choice(hosts), rng.choice(["", "/", "/p/q/r", "/pz", "/zz"])) for i in range(80)], "id long, host string, path string")
    in_line = sorted(url_rules.with_rules(urls, rules, inline=1000).collect())
    assert in_line == sorted(url_rules.with_rules(urls, rules, inline=0).select("id", "host", "path", "rule", "ruled").collect())
    assert any(r.rule for r in in_line)
