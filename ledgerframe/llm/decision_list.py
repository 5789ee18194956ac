"""Quality rules: a learned decision list over text statistics.

Statistics of every whole text are computed in Arrow batches. A bounded sample
of labelled texts (``SAMPLE_ROWS``, the lowest hashes of their ids) is split
into a growing and a pruning part. Sequential covering then learns rules for
label 0: a rule grows one threshold at a time by information gain until it
covers no good text of the growing part, is pruned backwards on the pruning
part, is kept if it is precise enough there, and what it covers is taken out
before the next rule. The list becomes one ordered Spark ``when`` expression,
which the rest of the table is filtered by, without Python.

Words are longest runs of characters other than space and U+0009 to U+000D.

Edge cases: null text counts as empty (no words, so it fails the base rule);
rows without a label are not learned from; with no labelled rows, or labels of
one kind only, the list is empty and only the base rule decides; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, byte_values, offsets

SAMPLE_ROWS = 6_000
#: Conditions of one rule. The number of rules has no bound: covering ends when no rule is precise enough.
MAX_CONDITIONS = 4
#: A rule needs this precision and this many covered texts on the pruning part.
MIN_PRECISION, MIN_COVER = 0.97, 5
SYMBOLS = b"#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_distinct_words long, n_lines long, n_upper long, n_digits long, n_chars long"
STAT_NAMES = tuple(x.split()[0] for x in STATS.split(", "))
#: What the rules may test, as SQL over the statistics.
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(n_chars, 1)",
    "digit_share": "n_digits / greatest(n_chars, 1)",
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_UPPER = np.zeros(256, dtype=bool)
_IS_UPPER[ord("A") : ord("Z") + 1] = True
_IS_DIGIT = np.zeros(256, dtype=bool)
_IS_DIGIT[ord("0") : ord("9") + 1] = True
_IS_LEAD = np.ones(256, dtype=bool)
_IS_LEAD[0x80:0xC0] = False


def _owners(lists: pa.Array) -> np.ndarray:
    at = np.asarray(lists.offsets, dtype=np.int64)
    return np.repeat(np.arange(len(lists)), np.diff(at))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the row of each."""
    parts = pc.ascii_split_whitespace(texts)
    words, owner = parts.flatten(), _owners(parts)
    real = pc.not_equal(pc.binary_length(words), 0)
    return words.filter(real), owner[real.to_numpy(zero_copy_only=False)]


def _codes(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """Statistics per text, for a string array without nulls of moderate total size."""
    rows = len(texts)

    def per_text(owner, weights=None):
        return np.bincount(owner, weights, minlength=rows).astype(np.int64)

    at = offsets(texts) - offsets(texts)[0]
    data = byte_values(texts)
    byte_owner = np.repeat(np.arange(rows, dtype=np.int32), np.diff(at))

    def counted(kind):
        return per_text(byte_owner[kind[data]])

    words, owner = split_words(texts)
    codes = _codes(words)
    n = per_text(owner)
    out = {
        "n_words": n, "word_chars": per_text(owner, pc.utf8_length(words).to_numpy(zero_copy_only=False)), "n_symbols": counted(_IS_SYMBOL),
        "n_upper": counted(_IS_UPPER), "n_digits": counted(_IS_DIGIT), "n_chars": counted(_IS_LEAD),
    }
    kinds = int(codes.max()) + 1 if len(codes) else 1
    seen = np.unique(owner * kinds + codes)
    out["n_distinct_words"] = per_text(seen // kinds)

    # three-word windows that occur at least twice in their text, and the words under them
    repeated = np.zeros(len(codes) + 2, dtype=bool)
    if len(codes) >= 3:
        inside = np.flatnonzero(owner[2:] == owner[:-2])
        _, pairs = np.unique(codes[:-1] * kinds + codes[1:], return_inverse=True)
        _, grams = np.unique(pairs[inside] * kinds + codes[inside + 2], return_inverse=True)
        n_grams = int(grams.max()) + 1 if len(grams) else 1
        _, which, times = np.unique(owner[inside] * n_grams + grams, return_inverse=True, return_counts=True)
        starts = inside[times[which] >= 2]
        for step in range(3):
            repeated[starts + step] = True
    out["n_repeat_words"] = per_text(owner[repeated[: len(codes)]])

    parts = pc.split_pattern(texts, "\n")
    lines, line_owner = parts.flatten(), _owners(parts)
    wordy = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line_codes, line_owner = _codes(lines)[wordy], line_owner[wordy]
    out["n_lines"] = per_text(line_owner)
    line_kinds = int(line_codes.max()) + 1 if len(line_codes) else 1
    out["n_dup_lines"] = out["n_lines"] - per_text(np.unique(line_owner * line_kinds + line_codes) // line_kinds)
    return out


def with_stats(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows of (doc_id, statistics)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for start, stop in byte_slices(texts):
                found = text_stats(texts.slice(start, stop - start))
                yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), *(pa.array(found[x]) for x in STAT_NAMES)], ["doc_id", *STAT_NAMES])

    return slim.mapInArrow(stats, f"doc_id long, {STATS}")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> F.Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


def _covers(rule: list[Condition], x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule])


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> Condition | None:
    """The threshold with the highest FOIL gain on the covered texts."""
    p0, n0 = bad.sum(), (~bad).sum()
    base = np.log2(p0 / (p0 + n0))
    best, found = 1e-9, None
    for name in FEATURES:
        order = np.argsort(x[name], kind="stable")
        v, b = x[name][order], bad[order]
        ends = np.flatnonzero(v[1:] > v[:-1])
        if not len(ends):
            continue
        p_low = np.cumsum(b)[ends]
        n_low = ends + 1 - p_low
        for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            gain = p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1)) - base)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], Condition(name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2))
    return found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray) -> list[list[Condition]]:
    """Sequential covering: ordered rules, each a conjunction of thresholds, for ``bad`` texts."""
    part = lambda rows: {k: v[rows] for k, v in x.items()}
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), dtype=bool)
    while True:
        inside = left & grow
        if not bad[inside].any() or bad[inside].all():
            break
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS and (~bad[inside]).any():
            condition = _best_condition(part(inside), bad[inside])
            if condition is None:
                break
            rule.append(condition)
            inside = inside & condition.holds(x)
        held = left & ~grow

        def worth(r: list[Condition], held=held) -> tuple[float, int]:
            hit = _covers(r, x) & held
            p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
            return ((p - n) / max(p + n, 1), p)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule:
            break
        hit = _covers(rule, x) & held
        if hit.sum() < MIN_COVER or bad[hit].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample_rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """Learns the list from at most ``sample_rows`` labelled texts."""
    chosen = (
        labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
    known = with_stats(texts).join(F.broadcast(chosen), "doc_id").where(f"NOT ({BASE_FAILED})")
    rows = known.select("doc_id", "label", *(F.expr(sql).cast("double").alias(name) for name, sql in FEATURES.items())).orderBy(F.xxhash64("doc_id"), "doc_id", "label", "n_words").limit(2 * sample_rows).toPandas()
    bad = rows["label"].to_numpy() == 0
    if not len(bad) or bad.all() or not bad.any():
        return []
    grow = np.arange(len(bad)) % 3 != 2
    return learn({name: rows[name].to_numpy(dtype=float) for name in FEATURES}, bad, grow)


def verdict(rules: list[list[Condition]]) -> F.Column:
    """The list as one ordered expression: null where no rule fires, else the rule's number from 1."""
    fired = F.when(F.lit(False), F.lit(0))
    for number, rule in enumerate(rules, 1):
        test = F.lit(True)
        for condition in rule:
            test = test & condition.column()
        fired = fired.when(test, F.lit(number))
    return fired


def apply_rules(docs: DataFrame, rules: list[list[Condition]], id_col="doc_id", text_col="text") -> DataFrame:
    """Rows of (doc_id, statistics, base_failed, rule, kept)."""
    return (
        with_stats(docs, id_col, text_col).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )
