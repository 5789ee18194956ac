"""Corpus operators against brute force, on small tables with every awkward case."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from ledgerframe.llm import context_pii, curriculum_mix, decision_list, host_boilerplate, piece_codec, queries, range_shards, rindex, simhash_tiles, subword_classifier, suffix_dedup, va_topk

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that operators use inside.
CLASHES = ("size", "key", "h", "fp", "score", "block", "rng", "bucket", "order", "base", "words", "target", "kept")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared = sentence(rng, 30)
    plain = [(i, sentence(rng, rng.randrange(1, 60)), "en", f"s{i % 4}", 1) for i in range(24)]
    odd = [
        (100, None, None, None, None), (101, "", "en", "s0", 0), (102, "\n \t ", "en", "s1", 3), (103, "a " * 3000 + shared, "en", "s2", 1), (104, "x" * 5000, "en", None, 1), (105, "日本 \U0001F600 " + shared, "ja", "s0", 1),
        (106, shared, "en", "s3", 1), (107, shared, "en", "s3", 1), (107, shared, "en", "s3", 1), (108, shared + ".", "en", "s9", 1), (None, shared, "en", "s1", 1), (None, "no id " + sentence(rng, 20), "en", "s1", 1),
        (109, "Mail a.b+c@x.example.com, call +1 (269) 555-3296 or 10.0.0.300 10.1.2.3; card 4111 1111-1111 1111 4111111111111112", "en", "s0", 1), (110, " lead  two▁mark <s> \x00 end ", "en", "s0", 1),
    ]
    return plain + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(1) for c in CLASHES})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def collected(df):
    return df.collect()


def test_rindex_against_brute_force():
    rng = random.Random(1)
    for trial in range(20):
        letters = b"ab" if trial % 2 else b"abcdefgh \n"
        held = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 10))] + [b"a" * 30]
        index = rindex.RunIndex.build(held)
        suffixes = [((*(x + 1 for x in s[i:]), 0, k), 0) for k, s in enumerate(held) for i in range(len(s) + 1)]
        assert index.order.tolist() == [i for _, i in sorted((s, i) for i, (s, _) in enumerate(suffixes))]
        most = rng.choice([3, 5, 9])
        patterns = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 20))) for _ in range(4)] + held[:3]
        groups, flat = index.intervals(most), b"\xff".join(held) + b"\xff"
        for p, found in zip(patterns, index.stream(patterns, most), strict=True):
            for i in range(len(p)):
                w = p[i : i + most]
                assert (found[i] >= 0) == (len(w) == most and any(w in s for s in held))
                if found[i] >= 0:
                    same = {r for r in range(len(index.order)) if flat[index.order[r] :].startswith(w)}
                    assert same == set(np.flatnonzero(groups == groups[found[i]]))


def removed(rows):
    ids = {i: (1 << 63) - 1 if r[0] is None else r[0] for i, r in enumerate(rows)}
    texts = {i: (r[1] or "").encode() for i, r in enumerate(rows)}
    first = {}
    for i in sorted(ids, key=ids.get):
        for k in range(len(texts[i]) - 49):
            first.setdefault(texts[i][k : k + 50], ids[i])
    out = []
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < ids[i]:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1]))
        out.append((rows[i][0], len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup(docs, none, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 6_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2_000)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1_500)
    monkeypatch.setattr(suffix_dedup, "HOT_DOCUMENTS", hot)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in collected(suffix_dedup.remove_repeats(docs))]
    assert sorted(got, key=repr) == sorted(removed(rows), key=repr)
    assert collected(suffix_dedup.remove_repeats(none)) == []


def test_piece_codec(docs, none, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = collected(piece_codec.encode(docs, PIECES))
    wanted = sorted((r[0], library.encode(r[1] or "", add_eos=True), r[1] or "") for r in rows if r[0] is not None)
    assert sorted((r.doc_id, r.ids) for r in got if r.doc_id is not None) == [(i, x) for i, x, _ in wanted]
    codec = piece_codec.Codec(PIECES)
    for r in got:
        assert r.decoded == library.decode(r.ids) and r.ends == sorted(r.ends)
    for i, ids, text in wanted:
        ends = next(r.ends for r in got if r.doc_id == i and r.ids == ids)
        _, source = codec.align(text.encode())
        assert ends == source[np.cumsum(codec.lengths[ids])].tolist() if text else ends == [0]
    assert collected(piece_codec.encode(none, PIECES)) == []


def test_bytes_cut_at_the_spans_are_the_pieces():
    codec, library = piece_codec.Codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(6)
    texts = ["", " ", "a", "  two  spaces ", "tab\tline\n\nend", "日本語 \U0001F600\U0001F9EC x", "naïve café ▁mark", "x" * 3000, "\x00\x01"]
    texts += ["".join(rng.choice("ab éß語\U0001F600  .\n") for _ in range(rng.randrange(1, 200))) for _ in range(50)]

    def surface(piece):
        if library.is_control(piece):
            return b""
        name = library.id_to_piece(piece)
        return bytes([int(name[3:5], 16)]) if library.is_byte(piece) else name.replace("▁", " ").encode()

    column = pa.array(texts)
    ids, per_text = codec.ids(column)
    ends, at = codec.span_ends(column, ids, per_text).tolist(), 0
    for text, n in zip(texts, per_text.tolist(), strict=True):
        raw, spans, pieces = text.encode(), ends[at : at + n], ids[at : at + n].tolist()
        cuts = [raw[a:b].replace("▁".encode(), b" ") for a, b in zip([0, *spans], spans, strict=False)]
        whole = [surface(x) for x in pieces]
        whole[0] = whole[0].removeprefix(b" ")  # the space that the library puts in front of a text
        assert cuts == whole and (not n or spans[-1] == len(raw))
        at += n


def test_character_map_takes_the_longest_prefix():
    """A hand-made double array with the keys "a", "ab" and "é", whose values are "X", "Y" and "e"."""
    keys, pool = {b"a": 0, b"ab": 2, "é".encode(): 4}, b"X\0Y\0e\0"
    units = [0] * 4096
    free = [512]

    def place(prefix, node):
        children = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        base = free[0]
        free[0] += 256
        units[node] = (units[node] & 0x800001FF) | ((node ^ base) << 10)
        if prefix in keys:
            units[node] |= 1 << 8
            units[base] = 0x80000000 | keys[prefix]
        for c in children:
            units[base ^ c] = c
            place(prefix + bytes([c]), base ^ c)

    place(b"", 0)
    blob = (4 * len(units)).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + pool
    cmap = piece_codec.CharacterMap(blob)
    assert [cmap.longest(b"abc", 0), cmap.longest(b"ac", 0), cmap.longest(b"c", 0)] == [(2, 2), (1, 0), None]
    codec = piece_codec.Codec(PIECES)
    codec.map, codec.plain = cmap, False
    out, source = codec.align("ab éa".encode())
    assert out.decode() == "▁Y▁eX" and source.tolist() == [0, 0, 0, 0, 2, 2, 2, 3, 5, 6]


MENU = "<div>Home News Sports Weather Contact About Login Help Terms Privacy</div>"


def test_host_boilerplate(spark, monkeypatch):
    page = lambda i: f"<body>{MENU}<div>own words w{i} x{i} y{i}</div><p class='ad big'>buy</p><script>var t='</p>';</script>"
    article = f"<nav><a>Home</a></nav>{MENU}<article><h1>T &amp;  t</h1><p>one<b>two</b><br><p>three&nbsp;4<div class='comments'><p>me too</div><ul><li>a<li>b</ul></article><footer>f"
    rows = [(i, f"http://a.com/{i}", page(i)) for i in range(3)] + [(7, "http://b.com/1", page(7)), (8, "x", article), (8, "x", article), (9, None, None), (10, "u", ""), (None, "http://a.com/0", "<p>lone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "key": F.lit(2), "text": F.lit("no")})
    wanted = {(i, f"w{i} x{i} y{i}") for i in range(3)}  # "own words" ends a string of more than eight words that the host repeats
    for hot in (2_000, 1):
        monkeypatch.setattr(host_boilerplate, "HOT_CONTEXTS", hot)
        got = [(r.page_id, r.text) for r in collected(host_boilerplate.main_text(df))]
        assert len(got) == len(rows)
        assert wanted <= set(got)
        assert (7, MENU[5:-6] + "\nown words w7 x7 y7") in got
        assert got.count((8, "T & t\nonetwo\nthree 4\na\nb")) == 2
        assert (9, "") in got and (10, "") in got and (None, "lone") in got
    assert collected(host_boilerplate.main_text(df.limit(0))) == []


def test_curriculum_mix(docs, none, rows):
    got = collected(curriculum_mix.curriculum_mix(docs))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), size(r[1])) for r in rows)
    source = {}
    for r in rows:
        source[r[3]] = source.get(r[3], 0) + size(r[1])
    names = sorted((s for s in source if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = sum(source.values()) - sum(3 * source[s] for s in capped)
        over = {s for s in names if s not in capped and left * weight[s] / sum(weight[x] for x in names if x not in capped) > 3 * source[s]}
        if not over:
            break
        capped |= over
    for s in names:
        target[s] = 3 * source[s] if s in capped else left * weight[s] / sum(weight[x] for x in names if x not in capped)
    of = {}
    for r in got:
        assert r.taken <= 3 * r.size and len(r.positions) >= r.taken // max(r.size, 1)
        assert all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
        of.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    for s in names:
        assert sum(of[source[s], round(target[s], 6)]) == sum(int(np.floor(target[x] + 0.5)) for x in names if (source[x], round(target[x], 6)) == (source[s], round(target[s], 6)))
    assert sorted(map(repr, got)) == sorted(map(repr, collected(curriculum_mix.curriculum_mix(docs))))
    assert collected(curriculum_mix.curriculum_mix(none)) == []


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def seeds(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if good(kind, m[0]))


def test_context_pii_base(docs, none, rows):
    got = collected(context_pii.find_personal_data(docs))
    assert sorted((repr(r.doc_id), [tuple(s) for s in r.base]) for r in got) == sorted((repr(r[0]), seeds(r[1] or "")) for r in rows)
    assert all(set(r.base) <= set(r.spans) for r in got)
    assert collected(context_pii.find_personal_data(none)) == []


def test_context_pii_learns_a_pattern_and_redacts(spark):
    texts = [(i, f"word {i}x mailbox: user{i}@mail.example.com tail") for i in range(8)] + [(50, "mailbox: user50-at-mail end"), (51, "other: user51-at-mail"), (52, "1" * 3000 + " 1 2" * 3000)]
    got = {r.doc_id: r for r in collected(context_pii.find_personal_data(spark.createDataFrame(texts, "doc_id long, text string")))}
    assert [tuple(s) for s in got[50].spans] == [(9, 0, 23)] and not got[50].base and not got[51].spans
    df = spark.createDataFrame([("a b@c.de +1 555 123 4567x", [(2, 0, 8), (4, 3, 9), (9, 3, 24)])], "t string, s array<struct<start:int,kind:int,end:int>>")
    assert df.select(context_pii.redact(F.col("t"), F.col("s"))).first()[0] == "a [EMAIL][PHONE]x"


def test_range_shards(docs, none, rows, spark):
    got = collected(range_shards.shard_by_ranges(docs))
    text = lambda r: (r[1] or "").encode()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((repr(r[0]), len(text(r)) + 8, zlib.crc32(text(r))) for r in rows)
    slots = {}
    for r in got:
        assert 0 <= r.shard < 24
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text everywhere").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")))).alias("text"))
    load = {}
    for r in collected(range_shards.shard_by_ranges(many)):
        load[r.shard] = load.get(r.shard, 0) + r.size
    assert len(load) == 24 and max(load.values()) - min(load.values()) < 0.03 * sum(load.values()) / 24
    assert collected(range_shards.shard_by_ranges(none)) == []


def test_subword_classifier(spark, docs, none):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(30))
    bad = lambda: " ".join(rng.choice(WORDS) + "###" for _ in range(30))
    texts = [(i, good() if i % 2 else bad(), i % 2) for i in range(300)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, quality int")
    model = subword_classifier.fit(frame.select("doc_id", "text"), frame.select("doc_id", "quality"))
    scored = {r.doc_id: r.score for r in collected(subword_classifier.score(frame, model))}
    held = [i for i, _, _ in texts if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scored[i] >= 0.5) == bool(i % 2) for i in held]) > 0.97
    everything = collected(subword_classifier.score(docs, model))
    assert len(everything) == docs.count() and all(0 <= r.score <= 1 for r in everything)
    assert collected(subword_classifier.score(none, model)) == []
    unlearned = subword_classifier.fit(docs, frame.select("doc_id", "quality").limit(0))
    assert {r.score for r in collected(subword_classifier.score(docs, unlearned))} == {0.5}


def test_va_topk(spark, monkeypatch):
    monkeypatch.setattr(va_topk, "BLOCK", 64)
    monkeypatch.setattr(va_topk, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[20][1]) for i in range(60)] + [(400, None), (401, [0.1] * 15 + [None]), (402, [float("nan")] * 16), (403, [float("inf")] * 16), (404, []), (None, vectors[0][1]), (420, [0.1, 0.2]), (421, [0.3, 0.4])]
    # Repeats: a whole row twice, one id with two vectors, and vectors that differ by less than a step.
    vectors += [(20, vectors[20][1]), (20, vectors[21][1]), (7, vectors[7][1]), (8, [x + 1e-9 for x in vectors[8][1]]), (460, [0.5]), (460, [0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3).withColumns({c: F.lit(1) for c in ("v", "dim", "cb", "n", "qb", "least", "asks")})
    clean = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    wanted = []
    for at, (q, x) in enumerate(clean):
        if q % 20 == 0:
            scores = sorted((-int(np.dot(x, v)), i) for other, (i, v) in enumerate(clean) if other != at and len(v) == len(x))
            wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:20])]
    assert sorted(tuple(r) for r in collected(va_topk.top_k(df, F.col("vec_id") % 20 == 0))) == sorted(wanted)
    assert collected(va_topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0)) == []


def test_va_topk_bounds_rule_out_no_answer():
    rng = np.random.default_rng(4)
    exact = rng.integers(-40, 40, (3000, 8))
    for width in (1, 3, 20):
        upper = va_topk.bounds(exact[:50], ((exact + 40) // width).astype(np.uint8), -40, width)
        products = exact[:50] @ exact.T
        assert (upper >= products).all() and (upper - products <= 2 * (1 + np.abs(exact[:50]).sum(axis=1))[:, None] * width).all()


def stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    repeated = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_decision_list_statistics(docs, none, rows):
    got = collected(decision_list.apply_rules(docs, []))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((repr(r.doc_id), *(r[f] for f in fields)) for r in got) == sorted((repr(r[0]), *stats(r[1] or "")) for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed) for r in got)
    tricky = ["a b c a b c", "a\nb\na\n \n ", "x y\n\nx y\nx  y", "", "# * | <>", "one two three one two three four one two three"]
    found = decision_list.text_stats(pa.array(tricky))
    assert [tuple(int(found[f][i]) for f in fields) for i in range(len(tricky))] == [stats(t) for t in tricky]
    assert collected(decision_list.apply_rules(none, [])) == []


def test_decision_list_learns_thresholds(spark, docs):
    rng = random.Random(9)
    texts = [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(50)) + ("##" if i % 4 == 0 else "") for _ in range(60)), int(i % 4 != 0)) for i in range(240)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, quality int")
    rules = decision_list.learn_rules(frame.select("doc_id", "text"), frame.select("doc_id", "quality"))
    assert rules
    assert all(r.kept == (r.doc_id % 4 != 0) for r in collected(decision_list.apply_rules(frame, rules)))
    assert decision_list.learn_rules(docs, frame.select("doc_id", "quality").limit(0)) == []


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0


def linked(prints, ids):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(ids))]


@pytest.mark.parametrize("share", [1000, 4])
def test_simhash_tiles(docs, none, rows, monkeypatch, share):
    monkeypatch.setattr(simhash_tiles, "HOT_SHARE", share)  # with 4, only keys of more than a quarter of the rows are hot
    got = collected(simhash_tiles.near_duplicates(docs))
    prints, ids = [fingerprint(r[1]) for r in rows], [r[0] for r in rows]
    roots = linked(prints, ids)
    lowest = {}
    for k, i in zip(roots, ids, strict=True):
        lowest[k] = min((x for x in (lowest.get(k), i) if x is not None), default=None)
    wanted = sorted((repr(i), p, repr(lowest[k])) for i, p, k in zip(ids, prints, roots, strict=True))
    assert sorted((repr(r.doc_id), r.fp % (1 << 64), repr(r.component_id)) for r in got) == wanted
    assert collected(simhash_tiles.near_duplicates(none)) == []


@pytest.mark.parametrize("fine", [1 << 21, 0])
def test_tile_links_keep_every_component(spark, monkeypatch, fine):
    monkeypatch.setattr(simhash_tiles, "FINE_ROWS", fine)
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in prints[:8]:
        for _ in range(12):
            prints.append(prints[-1] ^ (1 << rng.randrange(64)) if rng.random() < 0.5 else p ^ sum(1 << rng.randrange(64) for _ in range(3)))
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    edges = simhash_tiles.tile_links(frame, tile_rows=16)
    found = {r.node: r.root for r in collected(simhash_tiles.components(edges))}
    roots = linked(prints, prints)
    classes = {}
    for p, k in zip(prints, roots, strict=True):
        classes.setdefault(k, set()).add(p - (1 << 64) if p >> 63 else p)
    got = {}
    for p in prints:
        s = p - (1 << 64) if p >> 63 else p
        got.setdefault(found.get(s, s), set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))


def test_digest_columns(spark):
    row = queries.op1_suffix_dedup(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").first().text
    assert row.n_removed == 0 and row.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
