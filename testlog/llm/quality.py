"""Quality rules by distribution divergence (DataFrame functions only).

Every document gets two histograms: its characters by class and its words by the
common words of its language.  The reference of a language is the mean histogram
over all its documents that are long enough.  A document is rejected when the
Jensen-Shannon distance of one of its histograms to the reference is too large,
provided the document is long enough for the histogram to mean anything.

Defined results: a null text counts as empty; an empty or white-space text has zero
counts and fails the base rules; a null or unknown language is a language of its
own, without common words, so that only the character histogram is compared;
repeated rows give repeated rows; an empty table gives an empty table.  Columns of
the input are kept; a measure replaces an input column of the same name.

Repeats of three-word windows are found by sorting (hash, position) packed in one
long per window: the position takes as many low bits as the document needs, the
hash the others.  Neighbours of equal hash are compared by their words; a document in
which two different windows share a hash is sorted by the words themselves instead, so
counts are exact at any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testlog.operators.durable import store

# The most common words of each language.
COMMON_WORDS = {
    "en": "the of and to a in is that it for".split(),
    "de": "der die und in den von zu das sich mit".split(),
    "fr": "de la le et les en des un du une".split(),
    "es": "de la que el en y los las se del".split(),
}
LISTED = 10

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 2  # documents with more symbols are no part of a reference
# Character histograms: (characters at least, largest distance); short texts vary more.
CHAR_LIMITS = ((800, 0.17), (200, 0.30))
WORD_GUARD = 80  # words below which the common-word histogram is not judged
WORD_LIMIT = 0.40

SPACE = r"\x20\x09-\x0D"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Hash of one window ``w`` of three words.
WINDOW_HASH = "xxhash64(w)"
# Every working column carries this prefix, so that no input column can clash.
P = "__q_"


def _common_positions(words: Column, lang: Column) -> Column:
    """1-based place of each common word of the document, in text order."""

    def places(listed: list[str]) -> Column:
        table = F.array(*[F.lit(w) for w in listed])
        # a hashed test first: most words are none of these
        spellings = sorted({s for w in listed for s in (w, w.capitalize(), w.upper())})
        hits = F.filter(words, lambda w: w.isin(spellings))
        return F.transform(hits, lambda w: F.array_position(table, F.lower(w)))

    found = F.array().cast("array<long>")
    for name, listed in COMMON_WORDS.items():
        found = F.when(lang == name, places(listed)).otherwise(found)
    return found


def measure(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add the base measures and both histograms; one pass, no shuffle."""
    kept = [c for c in docs.columns if c not in MEASURES and not c.startswith(P)]
    body = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(
        *kept,
        body.alias(P + "text"),
        F.col(lang).alias(P + "lang"),
        F.array_remove(F.split(body, f"[{SPACE}]+"), "").alias(P + "words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias(P + "lines"),
        # what is left without letters is short, so later classes cost little
        F.regexp_replace(body, r"[\p{L}\p{M}]++", "").alias(P + "rest"),
        F.length(F.regexp_replace(body, r"\P{Lu}++", "")).alias(P + "upper"),
    )
    words = F.col(P + "words")
    rest = F.col(P + "rest")

    def count(chars: str) -> Column:
        return (F.length(rest) - F.length(F.regexp_replace(rest, chars, ""))).cast("long")

    size = F.size(words)
    windows = F.arrays_zip(
        F.slice(words, F.lit(1), F.greatest(size - 2, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(size - 2, F.lit(0))),
        F.slice(words, F.lit(3), F.greatest(size - 2, F.lit(0))),
    )
    second = first.select(
        *kept,
        P + "lang",
        F.length(P + "text").cast("long").alias(P + "chars"),
        F.length(rest).cast("long").alias(P + "rest_chars"),
        F.col(P + "upper").cast("long").alias(P + "upper"),
        size.cast("long").alias("n_words"),
        F.length(F.bin(size.cast("long"))).alias(P + "bits"),
        F.expr(f"shiftleft(1L, length(bin(CAST(size({P}words) AS BIGINT)))) - 1L").alias(P + "mask"),
        count(f"[{SPACE}]++").alias(P + "spaces"),
        count(r"[#*$%&|<>]++").alias("n_symbols"),
        count(r"\p{N}++").alias(P + "digits"),
        (F.size(P + "lines") - F.size(F.array_distinct(P + "lines"))).cast("long").alias("n_dup_lines"),
        P + "words",
        windows.alias(P + "windows"),
        _common_positions(words, F.col(P + "lang")).alias(P + "common"),
    )
    third = second.withColumn(
        P + "sorted",
        F.sort_array(
            F.expr(
                f"transform({P}windows, (w, i) -> shiftleft({WINDOW_HASH}, {P}bits) | CAST(i AS BIGINT))"
            )
        ),
    ).drop(P + "windows")
    packed = F.col(P + "sorted")
    n = F.greatest(F.size(packed) - 1, F.lit(0))
    # below: neighbours in this order that differ in the position only, as one long of both positions
    common = F.col(P + "common")
    per_word = [(F.size(common) - F.size(F.array_remove(common, F.lit(k).cast("long")))).cast("double")
                for k in range(1, LISTED + 1)]
    fourth = third.select(
        *kept,
        P + "lang", P + "chars", P + "upper", P + "spaces", P + "digits", P + "rest_chars",
        P + "bits", P + "mask", P + "words",
        "n_words", "n_symbols", "n_dup_lines",
        (F.col(P + "chars") - F.col(P + "spaces")).alias("word_chars"),
        F.slice(packed, F.lit(1), n).alias(P + "left"),
        F.slice(packed, F.lit(2), n).alias(P + "right"),
        F.array(*per_word, (F.col("n_words") - F.size(common)).cast("double")).alias(P + "word_counts"),
    )
    same_hash = f"(a ^ b) BETWEEN 0 AND {P}mask"
    same_words = " AND ".join(
        f"element_at({P}words, CAST(a & {P}mask AS INT) + {k}) = element_at({P}words, CAST(b & {P}mask AS INT) + {k})"
        for k in (1, 2, 3)
    )
    twins = (
        f"array_remove(zip_with({P}left, {P}right, (a, b) -> IF({same_hash}, "
        f"shiftleft(a & {P}mask, {P}bits) | (b & {P}mask), -1L)), -1L)"
    )
    # only for documents in which two windows share a hash: neighbours in the order of the words themselves
    by_words = (
        f"transform(array(sort_array(transform(sequence(1, size({P}words) - 2), "
        f"i -> struct(slice({P}words, i, 3) AS w, CAST(i - 1 AS BIGINT) AS i)))), "
        f"s -> array_remove(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> "
        f"IF(a.w = b.w, shiftleft(a.i, {P}bits) | b.i, -1L)), -1L))[0]"
    )
    clash = f"exists(zip_with({P}left, {P}right, (a, b) -> {same_hash} AND NOT ({same_words})), x -> x)"
    fourth = fourth.withColumn(P + "twins", F.expr(f"IF({clash}, {by_words}, {twins})")).drop(P + "words")
    repeated = F.expr(
        f"CAST(size(array_distinct(flatten(transform({P}twins, t -> array("
        f"shiftright(t, {P}bits), shiftright(t, {P}bits) + 1, shiftright(t, {P}bits) + 2, "
        f"t & {P}mask, (t & {P}mask) + 1, (t & {P}mask) + 2))))) AS BIGINT)"
    )
    letters = F.col(P + "chars") - F.col(P + "rest_chars") - F.col(P + "upper")
    other = F.col(P + "rest_chars") - F.col(P + "spaces") - F.col("n_symbols") - F.col(P + "digits")
    counts = F.array(
        *[c.cast("double") for c in (letters, F.col(P + "upper"), F.col(P + "digits"), F.col(P + "spaces"),
                                     F.col("n_symbols"), other)]
    )

    def shares(values: str, total: str) -> Column:
        return F.transform(values, lambda x: x / F.greatest(F.col(total), F.lit(1)).cast("double"))

    return (
        fourth.select("*", repeated.alias("n_repeat_words"), counts.alias(P + "char_counts"))
        .select(
            *kept,
            *MEASURES,
            F.col(P + "lang"),
            F.col(P + "chars"),
            shares(P + "char_counts", P + "chars").alias(P + "char_hist"),
            shares(P + "word_counts", "n_words").alias(P + "word_hist"),
        )
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )


def references(measured: DataFrame) -> DataFrame:
    """Mean histograms of each language over all documents that look like prose: long
    enough, not repetitive, and with few symbols."""

    def mean(column: str, size: int) -> Column:
        return F.array(*[F.avg(F.col(column)[i]) for i in range(size)])

    return (
        measured.filter(~base_failed() & (F.col("n_symbols") * 100 <= F.col("word_chars") * MAX_SYMBOL_PERCENT))
        .groupBy(F.col(P + "lang").alias(P + "ref_lang"))
        .agg(mean(P + "char_hist", 6).alias(P + "char_ref"), mean(P + "word_hist", LISTED + 1).alias(P + "word_ref"))
    )


def js_distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares; 0 to 1."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def judge(measured: DataFrame) -> DataFrame:
    """Add base_failed, both distances and kept to a stored table of measures.

    The references are one row per language; the join is left to Spark's size check.
    """
    refs = store(references(measured))
    char_limit = F.lit(1.0)
    for least, limit in sorted(CHAR_LIMITS):
        char_limit = F.when(F.col(P + "chars") >= least, limit).otherwise(char_limit)
    # a language without a listed document has no reference and nothing to compare
    joined = measured.join(refs, F.col(P + "lang").eqNullSafe(F.col(P + "ref_lang")), "left")
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("char_distance", js_distance(P + "char_hist", P + "char_ref"))
        .withColumn("word_distance", js_distance(P + "word_hist", P + "word_ref"))
        .withColumn(
            "kept",
            ~F.col("base_failed")
            & (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= char_limit)
            & (
                (F.col("n_words") < WORD_GUARD)
                | ~F.coalesce(F.col(P + "lang").isin(list(COMMON_WORDS)), F.lit(False))
                | (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= WORD_LIMIT)
            ),
        )
        .drop(*[c for c in joined.columns if c.startswith(P)])
    )


def quality_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of measures and verdict per document; the text is read once and not kept."""
    narrow = measure(docs.select(id_col, "text", "lang")).drop("text", "lang")
    return judge(store(narrow))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns unchanged."""
    rows = docs.select(F.struct(*docs.columns).alias("row_kept"), "text", "lang")
    return judge(store(measure(rows).drop("text", "lang"))).filter("kept").select("row_kept.*")
