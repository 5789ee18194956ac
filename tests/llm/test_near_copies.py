"""The pipeline's near-copy stage against brute force over whole shingle sets."""

import random
from itertools import combinations

import corpus_pipeline
from ledgerframe.llm import shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[top(j)] = top(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    return list(groups.values())


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=repr)


def test_near_copies_match_brute_force(spark):
    rng = random.Random(3)
    line = " ".join(f"common{i}" for i in range(9))
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(8, 90))) for _ in range(25)]
    for base in texts[:12]:
        for _ in range(6):  # copies of copies, from close to just beyond the bound
            words = base.split()
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(words))
    texts += [f"{line} {t}" for t in texts[:10]] + ["a b c", "A  b c", "a b d", "", "  ", None]
    rng.shuffle(texts)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    wanted = [min((rows[k] for k in g), key=lambda r: (r[0] is None, r[0] or 0)) for g in brute(rows)]
    got = kept(spark, rows)
    assert len(got) == len(wanted)
    ids = lambda found: sorted(i for i, _ in found if i is not None)
    assert ids(got) == ids(wanted)


def test_clashing_ids_keep_both_texts(spark):
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (1, "one two three four five six")]
    assert kept(spark, rows) == sorted(set(rows), key=repr)


def test_similar_sets_far_apart_in_fingerprint(spark):
    from ledgerframe.llm import simhash_tiles

    a = " ".join(f"t{i}" for i in range(60))
    b = a + " " + " ".join(f"u{i}" for i in range(10))
    x, y = simhash_tiles.fingerprints([a, b]).tolist()
    assert (x ^ y).bit_count() > simhash_tiles.RADIUS and len(shingle_sets.shingle_set(a)) / len(shingle_sets.shingle_set(b)) >= 0.8
    assert kept(spark, [(1, a), (2, b)]) == [(1, a)]


def test_fingerprints_of_operator_ten_are_the_first_step(spark, monkeypatch):
    from ledgerframe.llm import simhash_tiles

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(400)) for _ in range(6)]
    texts += [f"{t} x{i}" for i, t in enumerate(texts)] + [f"y{i} {t}" for i, t in enumerate(texts)]
    prints = simhash_tiles.fingerprints(texts, shingle_sets.SHINGLE).tolist()
    near = {(i, j) for i, j in combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() <= simhash_tiles.RADIUS}
    seen, was = [], shingle_sets._near_prints
    monkeypatch.setattr(shingle_sets, "_near_prints", lambda named: seen.append(was(named).collect()) or was(named))
    got = kept(spark, list(enumerate(texts)))
    assert [i for i, _ in got] == list(range(6)) and near
    sigs = [shingle_sets._signature(shingle_sets.shingle_set(t)) for t in texts]
    linked = {frozenset((r.a % 2**64, r.b % 2**64)) for r in seen[0]}
    top = {s: s for s in sigs}

    def root(s):
        return s if top[s] == s else root(top[s])

    for a, b in map(tuple, linked):
        top[root(a)] = root(b)
    assert all(root(sigs[i]) == root(sigs[j]) for i, j in near)


def test_large_group_meets_few_pairs(spark, monkeypatch):
    """Copies of copies beside foreign texts with the same line: the last step meets no square of the group."""
    rng = random.Random(11)
    line = " ".join(f"line{i}" for i in range(12))
    base = [f"b{i}" for i in range(140)]
    rows = [(0, " ".join(base) + " " + line)]
    for i in range(1, 301):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words) + " " + line))
    rows += [(1000 + i, " ".join(f"f{rng.randrange(10**6)}" for _ in range(100)) + " " + line) for i in range(40)]
    pairs, was = [], shingle_sets.cut

    def counted(df):
        out = was(df)
        if out.columns == ["a", "b"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(shingle_sets, "cut", counted)
    got = kept(spark, rows)
    wanted = [min(rows[k][0] for k in g) for g in brute([(i, t) for i, t in rows])]
    assert [i for i, _ in got] == sorted(wanted)
    assert max(pairs) < 12 * len(rows), pairs


def test_many_partitions_are_read_by_few_tasks_and_texts_shuffled_once(spark):
    """With many shuffle partitions, what a checkpoint holds in few rows goes on in few tasks; same rows as ever."""
    from ledgerframe.llm import common, simhash_tiles

    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    was = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("24", "false"), strict=True):
            spark.conf.set(n, v)
        edges = spark.createDataFrame([(i, i + 1) for i in range(10) if i != 4], "a long, b long")
        found = simhash_tiles.components(edges, save=common.gathered)
        assert found.rdd.getNumPartitions() <= max(2, spark.sparkContext.defaultParallelism)
        assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(1, 5)] + [(i, 5) for i in range(6, 11)]
        many = common.gathered(spark.range(24 * common.GATHERED_ROWS).repartition(24))
        assert many.rdd.getNumPartitions() == 24 and many.count() == 24 * common.GATHERED_ROWS
        assert common.gathered(edges.where("a < 0").groupBy("a").count()).collect() == []
        text = "one two three four five six seven"
        rows = [(1, text), (2, text), (None, text), (None, "eight nine ten eleven twelve"), (None, "eight nine ten eleven twelve"), (1, "a b")]
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
        plan = (kept_rows := corpus_pipeline.drop_near_copies(spark, docs, ""))._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc_id" not in plan and "_own" in plan
        assert sorted(((r.doc_id, r.text) for r in kept_rows.collect()), key=repr) == sorted([(1, text), (None, rows[3][1]), (1, "a b")], key=repr)
    finally:
        for n, v in zip(names, was, strict=True):
            spark.conf.set(n, v)
