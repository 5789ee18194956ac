"""Groups of a hot host stay bounded."""

import random

import numpy as np
import pytest
from ledgerframe.llm import host_boilerplate
from pyspark.sql import functions as F


def test_large_host_gets_more_parts(spark, monkeypatch):
    monkeypatch.setattr(host_boilerplate, "PARTS", 2)
    monkeypatch.setattr(host_boilerplate, "PART_WORDS", 100)
    contexts = spark.range(2000).select(F.when(F.col("id") < 1990, "hot").otherwise("small").alias("host"), F.col("id").alias("deal"), F.array_repeat(F.lit(1), 10).alias("context"))
    sizes = host_boilerplate.in_parts(contexts).groupBy("host", "part").agg(F.sum(F.size("context")).alias("words")).collect()
    assert sum(r.words for r in sizes) == 20000
    assert max(r.words for r in sizes if r.host == "hot") < 500 and len([r for r in sizes if r.host == "small"]) <= 2


def test_repeated_windows_against_a_plain_loop():
    rng, length = random.Random(3), host_boilerplate.LENGTH
    for letters in (1, 2, 5):
        contexts = [np.array([rng.randrange(letters) for _ in range(rng.randrange(1, 40))], dtype=np.int64) for _ in range(30)]
        first = np.array([rng.randrange(6) for _ in contexts])
        last = np.array([f + rng.randrange(2) * 3 for f in first.tolist()])
        pages = {}
        for c, f, t in zip(contexts, first.tolist(), last.tolist(), strict=True):
            for at in range(len(c) - length + 1):
                pages.setdefault(tuple(c[at : at + length]), set()).update((f, t))
        wanted = [[at for at in range(len(c) - length + 1) if len(pages[tuple(c[at : at + length])]) > 1] for c in contexts]
        assert [sorted(f) for f in host_boilerplate.repeated_windows(contexts, first, last)] == wanted


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article class='post with sidebar'><p>a</p><article class='comment'><p>nice</p></article><p>b</p></article>", ["a", "b"]),
        ("<article><p>a</p><article class='related teaser'><h2>more</h2><article>x</article></article><p>b</p></article><p>c", ["a", "b"]),
        ("<main><article class='teaser'>t</article><p>a</p><article><p>b</p></article></main>", ["a", "b"]),
        ("<article class='comment'>nice</article><article><p>a</p><article><p>part</p></article></article>", ["a", "part"]),
        ("<article id='comments'><p>one<article class='reply'><p>two</article></article><article>a", ["a"]),
    ],
)
def test_articles_inside_articles(page, text):
    assert host_boilerplate.page_blocks(page)[0] == text
