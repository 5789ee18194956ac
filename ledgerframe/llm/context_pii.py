"""Personal data: fixed rules as seeds, then bootstrapped contextual extraction.

The seeds are what four patterns find (leftmost, non-overlapping, per kind),
less the matches that fail their kind's test.

The method then works on runs of identifier-like words (those with a digit or an
at sign), whole runs with their spaces, and on their lexical patterns: the word
in front, the word behind, and both, lower-cased. Spark scores the graph of
patterns and runs in rounds. A run's confidence in a kind is 1 if a seed of that
kind lies in it and none of another kind, and else that of its best pattern,
damped. A pattern's confidence in a kind is the sum of its distinct runs'
confidence over that sum plus one, plus its runs that are seeds of other kinds or
have not the kind's shape, plus ``UNKNOWN`` for each run not judged yet; its
support is that sum, so runs found in one round back patterns in the next. After
the last round, patterns of ``MIN_SUPPORT`` and ``MIN_CONFIDENCE`` or more mark
the runs of their kind's shape that hold no seed. Seeds always stay.

Only DataFrame functions are used. A text is matched once a pattern; places are
running sums over the exploded matches, so the time is in proportion to the text
however many matches it has, and no array grows by appending. Regular
expressions are possessive and start at the edges of words only: their time is
linear in a word's length and their stack does not grow.

Edge cases: null text counts as empty (no spans); a null id is kept; repeated
rows give equal results each; texts of any length are read whole; columns of any
other name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns by kind; possessive where what follows cannot match what is given back, tried at the edge of a
# word or where the match before ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_WORD = r"[^\s0-9@]*+[0-9@]\S*+"
#: A run of identifier-like words, with the word in front of it.
RUN = rf"(?<!\S)(?:(\S++)\s++)?({_WORD}(?:[ ]{_WORD})*+)"
ROUNDS, DAMPING, UNKNOWN = 3, 0.95, 0.05
MIN_SUPPORT, MIN_CONFIDENCE = 5.0, 0.85
SPAN = "array<struct<start:int,kind:int,end:int>>"
_RUNS = len(KINDS)
#: Code points of a piece of text from which what stays is cut.
CHUNK = 2048


def of_kind(k: int):
    """A test of a span for higher-order functions."""
    return lambda s: s["kind"] == k


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def digit(i):
        return F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")

    def worth(i):
        return F.when(i % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(F.concat(F.lit("00"), p), -3, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(_digits(match)).between(14, 19), _luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _shape(kind: str, run: Column) -> Column:
    """Whether a run without a seed may be of the kind at all."""
    n = F.length(_digits(run))
    if kind == "email":
        return run.rlike(r"(?i)@|[^0-9A-Za-z]at[^0-9A-Za-z]")
    if kind == "ip":
        return run.rlike(r"^[^\s@]*[0-9A-Fa-f]++(?:[.:][0-9A-Fa-f]*+){2,}[^\s@]*$")
    if kind == "card":
        return n.between(12, 19) & ~F.contains(run, F.lit("@"))
    return n.between(7, 15) & ~F.contains(run, F.lit("@"))


def _matches(text: Column, k: int) -> Column:
    """(kind, gap, head, left, match) of every match of a pattern in text: ``gap`` code points lie between the
    match before and this one; a last row without match has what follows."""
    pattern = PATTERNS[KINDS[k]] if k < _RUNS else RUN
    gaps = F.split(text, pattern, -1)
    none = F.lit(None).cast("string")
    if k < _RUNS:
        zipped = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"))
        one = lambda x: F.struct(F.lit(k).alias("kind"), F.length(x["gap"]).alias("gap"), none.alias("head"), none.alias("left"), x["whole"].alias("whole"), x["whole"].alias("match"))
        kind = KINDS[k]
        tried = F.contains(text, F.lit(NEEDS[kind])) & text.rlike("[0-9@]") if kind in NEEDS else text.rlike("[0-9][ -]?[0-9]")
    else:
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(name) for i, name in enumerate(("whole", "left", "match"))]
        zipped = F.arrays_zip(gaps.alias("gap"), *parts)
        head = lambda g: F.nullif(F.regexp_extract(g, r"^\s*(\S*)", 1), F.lit(""))
        one = lambda x: F.struct(F.lit(k).alias("kind"), F.length(x["gap"]).alias("gap"), head(x["gap"]).alias("head"), F.nullif(x["left"], F.lit("")).alias("left"), x["whole"].alias("whole"), x["match"].alias("match"))
        tried = text.rlike("[0-9@]")
    return F.when(tried, F.transform(zipped, one)).otherwise(F.array().cast("array<struct<kind:int,gap:int,head:string,left:string,whole:string,match:string>>"))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of (row, doc_id, text_hash, found): every row with a number of its own and its matches, fixed by a checkpoint."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    return cut(slim.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), F.array(*(_matches(F.col("text"), k) for k in range(_RUNS + 1))).alias("found")
    ))


def placed_matches(rows: DataFrame) -> DataFrame:
    """Rows of (row, kind, start, end, match, left, right) from (row, found): matches of the four patterns, and runs as a fifth kind."""
    found = rows.select("row", F.explode("found").alias("of")).select("row", F.posexplode("of").alias("nth", "m")).select("row", "nth", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("nth")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.coalesce(F.length("whole"), F.lit(0))).over(so_far)
    behind = F.coalesce(F.lead("head").over(order), F.lead("left").over(order))
    placed = found.withColumns({"end": end.cast("int"), "right": behind}).where("match IS NOT NULL")
    return placed.select("row", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match", "left", "right")


def _patterns_of(left: Column, right: Column) -> Column:
    """The lexical patterns of a context: words without digits in front, behind and on both sides."""
    plain = lambda w: F.when(~w.rlike("[0-9@]"), F.lower(w))
    before, after = plain(left), plain(right)
    return F.array_compact(F.array(F.concat(F.lit("<"), before), F.concat(F.lit(">"), after), F.concat(F.lit("<>"), before, F.lit(" "), after)))


def confident_patterns(runs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows of (pattern, kind) that mark runs without seeds.

    ``runs`` has pattern, run, and per kind whether a seed of it lies in the run
    (``email`` ...) and whether the run has its shape (``email_shape`` ...).
    """
    of_runs = [F.max(c).alias(c) for k in KINDS for c in (k, f"{k}_shape")]
    edges = cut(runs.groupBy("pattern", "run").agg(*of_runs))
    one_kind = sum((F.col(k).cast("int") for k in KINDS), F.lit(0))
    seeds = edges.groupBy("run").agg(*of_runs).withColumn("n_kinds", one_kind)
    # Of runs with a seed: 1 for its kind if there is no other, else 0. Of others: what patterns lend them, if the shape allows.
    known = F.col("n_kinds") > 0
    state = seeds.select(
        "run", known.alias("known"), *(F.when(F.col("n_kinds") == 1, F.col(k).cast("double")).otherwise(0.0).alias(k) for k in KINDS),
        *((~known & F.col(f"{k}_shape")).alias(f"{k}_open") for k in KINDS),
    )
    for last in [False] * (rounds - 1) + [True]:
        scored = edges.select("pattern", "run").join(state, "run")
        sums = [F.sum(k).alias(k) for k in KINDS]
        against = [F.sum(F.when(F.col(f"{k}_open") & (F.col(k) == 0), UNKNOWN).when(F.col(f"{k}_open") | (F.col("known") & (F.col(k) > 0)), 0.0).otherwise(1.0)).alias(f"no_{k}") for k in KINDS]
        patterns = scored.groupBy("pattern").agg(*sums, *against).select("pattern", *(F.col(k).alias(f"n_{k}") for k in KINDS), *((F.col(k) / (F.col(k) + 1 + F.col(f"no_{k}"))).alias(k) for k in KINDS))
        if last:
            break
        good = lambda k: F.when((F.col(f"n_{k}") >= MIN_SUPPORT) & (F.col(k) >= MIN_CONFIDENCE), F.col(k) * DAMPING).otherwise(0.0)
        worthy = patterns.select("pattern", *(good(k).alias(f"up_{k}") for k in KINDS)).where(F.greatest(*(f"up_{k}" for k in KINDS)) > 0)
        lent = edges.select("pattern", "run").join(worthy, "pattern").groupBy("run").agg(*(F.max(f"up_{k}").alias(f"up_{k}") for k in KINDS))
        state = cut(state.join(lent, "run", "left").select(
            "run", "known", *(F.when(F.col(f"{k}_open"), F.greatest(k, F.coalesce(f"up_{k}", F.lit(0.0)))).otherwise(F.col(k)).alias(k) for k in KINDS), *(f"{k}_open" for k in KINDS)
        ))
    chosen = F.filter(F.array(*(F.struct(F.lit(i).alias("kind"), ((F.col(k) >= MIN_CONFIDENCE) & (F.col(f"n_{k}") >= MIN_SUPPORT)).alias("ok")) for i, k in enumerate(KINDS))), lambda x: x["ok"])
    return patterns.select("pattern", F.explode(chosen).alias("x")).select("pattern", F.col("x.kind").alias("kind"))


def _spans(rows: DataFrame) -> DataFrame:
    """Rows of (row, start, kind, end, base): base spans, and those that patterns add."""
    placed = cut(placed_matches(rows))
    passes = F.lit(False)
    for k, kind in enumerate(KINDS):
        passes = F.when(F.col("kind") == k, _passes(kind, F.col("match"))).otherwise(passes)
    base = placed.where(F.col("kind") < _RUNS).where(passes).select("row", "start", "kind", "end", F.lit(True).alias("base"))

    # A run and its base spans share a row and a place: the run is the last to start at or before the span.
    runs = placed.where(F.col("kind") == _RUNS).select("row", "start", F.lit(_RUNS).alias("kind"), "end", "match", "left", "right")
    mixed = runs.unionByName(base.drop("base").withColumns({c: F.lit(None).cast("string") for c in ("match", "left", "right")}))
    in_order = Window.partitionBy("row").orderBy("start", F.col("kind").desc(), "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_run = F.col("kind") == _RUNS
    mixed = mixed.withColumns({"at": F.max(F.when(is_run, F.col("start"))).over(in_order), "reach": F.max(F.when(~is_run, F.col("end"))).over(in_order)})
    held = mixed.groupBy("row", "at").agg(
        *(F.max(F.when(is_run, F.col(c))).alias(c) for c in ("end", "match", "left", "right", "reach")), *(F.bool_or(F.col("kind") == k).alias(name) for k, name in enumerate(KINDS))
    ).where("match IS NOT NULL")
    # Punctuation around a run is not of it.
    inner = F.regexp_extract("match", r"^[^0-9A-Za-z+(]*(.*?)[^0-9A-Za-z)]*$", 1)
    lead = F.length("match") - F.length(F.regexp_replace("match", r"^[^0-9A-Za-z+(]+", ""))
    clear = ~F.greatest(*KINDS) & (F.coalesce("reach", F.lit(0)) <= F.col("at"))  # nor does a span from further left run into it
    judged = cut(held.select(
        "row", (F.col("at") + lead).alias("start"), inner.alias("run"), clear.alias("clear"), *KINDS, *(_shape(k, inner).alias(f"{k}_shape") for k in KINDS),
        F.explode(_patterns_of(F.col("left"), F.col("right"))).alias("pattern"),
    ).withColumns({"end": F.col("start") + F.length("run"), "run": F.lower("run")}))
    patterns = confident_patterns(judged.select("pattern", "run", *KINDS, *(f"{k}_shape" for k in KINDS)))
    shaped = F.lit(False)
    for k, kind in enumerate(KINDS):
        shaped = F.when(F.col("kind") == k, F.col(f"{kind}_shape")).otherwise(shaped)
    added = judged.where("clear AND end > start").join(patterns, "pattern").where(shaped).select("row", "start", "kind", "end").distinct()
    return base.unionByName(added.withColumn("base", F.lit(False)))


def _islands(spans: DataFrame) -> DataFrame:
    """Rows of (row, start, end, kind): runs of overlapping spans, with the kind of the first."""
    order = Window.partitionBy("row").orderBy("start", "kind", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", (F.coalesce(before, F.lit(-1)) <= F.col("start")).cast("int"))
    numbered = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind", "end")).alias("kind"))


def find_personal_data(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows of (doc_id, text_hash, base, spans): spans of (start, kind, end) in code points, by start, then kind.

    ``spans`` holds the base spans and those that patterns add.
    """
    rows = _found(docs, id_col, text_col)
    spans, one, none = _spans(rows), F.struct("start", "kind", "end"), F.array().cast(SPAN)
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("base"), one))).alias("base"), F.array_sort(F.collect_list(one)).alias("spans"))
    joined = rows.select("row", "doc_id", "text_hash").join(by_row, "row", "left")
    return joined.select("doc_id", "text_hash", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _chunks(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _replaced(text: Column, chunks: Column, cuts: Column) -> Column:
    """``text`` with each of the cuts (start, end, kind), apart and in order, replaced by its kind.

    What stays is taken from the text's chunks, so no piece counts characters from the text's start.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    zipped = F.arrays_zip(cuts.alias("cut"), F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["end"])).alias("after"))

    def piece(x):
        upto = F.coalesce(x["cut"]["start"], (F.size(chunks) * CHUNK).cast("int"))
        i, j = F.floor(x["after"] / CHUNK).cast("int"), F.floor(upto / CHUNK).cast("int")
        at = lambda n: F.coalesce(F.get(chunks, n), F.lit(""))
        inside = F.substring(at(i), x["after"] % CHUNK + 1, upto - x["after"])
        across = F.concat(F.substring(at(i), x["after"] % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(at(j), F.lit(1), upto % CHUNK))
        return F.concat(F.when(i == j, inside).otherwise(across), F.coalesce(F.get(names, x["cut"]["kind"]), F.lit("")))

    return F.when(F.size(cuts) > 0, F.array_join(F.transform(zipped, piece), "")).otherwise(text)


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by its first kind in brackets."""
    def step(done, s):
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        own = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.when((F.size(done) > 0) & (last["end"] > s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, own))

    cuts = F.aggregate(spans, F.array().cast("array<struct<start:int,end:int,kind:int>>"), step)
    return _replaced(text, _chunks(text), cuts)


def hide_personal_data(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """All rows with every run of overlapping spans replaced by its first kind in brackets, and whether any was (``_hidden``).

    Rows that are equal in id and text are treated alike. Texts that hold no
    identifier-like word are passed on as they are, without a shuffle.
    """
    rows = _found(docs, id_col, text_col)
    listed = _islands(_spans(rows)).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_cuts"))
    cuts = rows.select("row", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).join(listed, "row").dropDuplicates(["_id", "_hash"]).drop("row")
    may_hold = F.coalesce(F.col(text_col).rlike("[0-9@]"), F.lit(False))
    keyed = docs.where(may_hold).withColumns({"_own": F.col(id_col), "_own_hash": F.xxhash64(text_col)})
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash"))
    joined = keyed.join(cuts, same, "left").withColumn("_chunks", F.when(F.col("_cuts").isNotNull(), _chunks(F.col(text_col))))
    hidden = F.when(F.col("_chunks").isNull(), F.col(text_col)).otherwise(_replaced(F.col(text_col), F.col("_chunks"), F.col("_cuts")))
    changed = joined.withColumns({text_col: hidden, "_hidden": F.col("_cuts").isNotNull()}).select(*docs.columns, "_hidden")
    return docs.where(~may_hold).withColumn("_hidden", F.lit(False)).unionByName(changed)
