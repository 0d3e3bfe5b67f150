"""Phrase collocations from a weighted graph of overlapping word windows.

Texts are cut into pieces, pieces into words.  The nodes of the graph are the word
sequences of a language, its edges the *longest grams*: the window of ``LONGEST`` words
that begins at a word, or the shorter rest where the piece ends first.  Only edges are
shuffled, once, with weights added up before.  All shorter counts come out of them: what
flows out of a node is the weight of the longer windows that begin with its words, and
the windows that stop there are the correction for piece ends, so that

    f(phrase) = weight of the windows that begin with the phrase.

Two neighbouring words that meet less often than ``min_count`` cannot both be in a phrase that
counts, so a window also stops between them, with the same correction.  Such pairs are found
beforehand by counting hashes of all pairs; the frequent ones are a bit table of fixed size, and
two pairs in one bit only make windows longer than they need be, never counts wrong.

Edges are dealt out by range and sorted, which puts the windows of every phrase next to
each other; one pass over a partition adds the flow up from the longest to the shortest
phrase with one open node per length.  A phrase that reaches over the border of a
partition leaves one partial count in each, which are added afterwards; a frequent word
or window is thus never in one task.  Then unary paths are compacted: a phrase whose
whole flow goes into one longer phrase, on its right or left, is part of that phrase and
no candidate of its own.  (If a much longer candidate holds it as often, so does one that
is longer by a word, as counts cannot rise on the way.)

Arithmetic is exact: products are decimals of 38 digits, scores their integer quotients.

Defined results: a null text counts as empty, a null language as ``und``; texts without
words give nothing; rows are counted as often as they stand there; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from testlog.llm import prefilter
from testlog.operators.durable import store

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
UNKNOWN = "und"
PART = 1 << 20  # bytes of text in one array of a task; longer texts are cut between words
HELD = 400_000  # windows that a task adds up before it hands them on
PAIRS = 3 << 20  # pairs of words that a task adds up before it hands them on
ROWS = 1 << 16  # windows in one Arrow batch
BITS = 1 << 26  # bits of the table of frequent pairs

# Lower case for A-Z, blanks as spaces, and every character that ends a piece as a line feed.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_ENDS)
)
# A space must sort before every character of a word.  "!" ends pieces, so it is free to
# stand for the few control characters that sort lower.
_LOW = bytes(c for c in range(0x20) if c not in b"\t\n\x0b\x0c\r")

_BREAK = re.compile(rb"[ \n]|$")
_BEHIND = re.compile(rb"(?:[ \n]+[^ \n]+){0,%d}" % (LONGEST - 1))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _escape(word: bytes) -> bytes:
    return b"".join(b"!%c" % (c + 0x40) if c < 0x20 else b"%c" % c for c in word)


def _unescape(phrase: bytes) -> bytes:
    first, *rest = phrase.split(b"!")
    return first + b"".join(b"%c" % (part[0] - 0x40) + part[1:] for part in rest)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _parts(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A folded text in parts of about ``PART`` bytes, with the bytes whose words are the part's own;
    behind them stand the next words, as far as a window reaches."""
    low = 0
    while len(text) - low > PART:
        cut = max(text.rfind(b" ", low + 1, low + PART), text.rfind(b"\n", low + 1, low + PART))
        if cut < 0:  # one word longer than a part
            cut = _BREAK.search(text, low + 1).start()
        yield text[low : _BEHIND.match(text, cut).end()], cut - low
        low = cut
    yield text[low:], len(text) - low


class _Words:
    """The words of some parts of texts: ``own`` marks those that belong to their part, ``pair`` has a hash
    of each word with the next one, ``joined`` tells whether that one is in the same piece."""

    def __init__(self, parts: list[tuple[str, bytes, int]]):
        self.raw = b"\n".join(part for _, part, _ in parts)
        buf = np.frombuffer(self.raw, np.uint8)
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = (buf != 32) & (buf != 10)
        turns = np.flatnonzero(np.diff(inside))
        starts, ends = turns[::2], turns[1::2]
        lengths = np.array([len(part) for _, part, _ in parts], np.int64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        at = np.searchsorted(begins, starts, side="right") - 1
        self.own = starts - begins[at] < np.array([own for _, _, own in parts], np.int64)[at]
        # words of each part: from first[k] to first[k + 1]
        self.first = np.searchsorted(starts, np.append(begins, len(buf) + 1))
        power = np.full(len(buf) + 1, _ODD)
        power[0] = 1
        power = np.cumprod(power)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
        inverse = np.full(len(buf) + 1, _INVERSE)
        inverse[0] = 1
        words = _mix((sums[ends] - sums[starts]) * np.cumprod(inverse)[starts])
        seeds = {lang: int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8]) for lang, _, _ in parts}
        words = words + np.array([seeds[lang] for lang, _, _ in parts], np.uint64)[at]
        pieces = np.cumsum(buf == 10)[starts]
        self.joined = np.zeros(len(starts), bool)
        self.joined[:-1] = pieces[1:] == pieces[:-1]
        self.pair = _mix(words * _ODD + np.roll(words, -1))


def _body(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes, int]]]:
    """Parts of folded texts, about ``PART`` bytes together."""
    held: list[tuple[str, bytes, int]] = []
    size = 0
    for batch in batches:
        for name, raw in zip(batch.column("lang").to_pylist(), batch.column("text")):
            folded = raw.as_py().translate(_FOLD)
            if len(folded.translate(None, _LOW)) < len(folded):
                folded = b"\n".join(b" ".join(map(_escape, p.split())) for p in folded.split(b"\n"))
            for part, own in _parts(folded):
                held.append((name, part, own))
                size += len(part) + 1
                if size >= PART:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def frequent_pairs(docs: DataFrame, min_count: int, text: str = "text", lang: str = "lang") -> np.ndarray:
    """Bit table of the hashes of word pairs that may be found ``min_count`` times."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def added(held: list[np.ndarray]) -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(n)], names=["pair", "n"])

        held: list[np.ndarray] = []
        with np.errstate(over="ignore"):
            for parts in _chunks(batches):
                words = _Words(parts)
                held.append(words.pair[words.joined & words.own])
                if sum(map(len, held)) >= PAIRS:
                    yield added(held)
                    held = []
            if held:
                yield added(held)

    counts = _body(docs, text, lang).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    enough = counts.filter(F.col("n") >= min_count)
    return prefilter.bit_table(enough.select(F.pmod("pair", F.lit(BITS)).alias("slot")), BITS)


def edges(docs: DataFrame, pairs: np.ndarray, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): windows with weights, several rows for one window.  Control characters
    in ``gram`` are escaped, so that its order is that of the words."""
    table = docs.sparkSession.sparkContext.broadcast(pairs)

    def batches_of(name: str, found: Counter[bytes]) -> Iterator[pa.RecordBatch]:
        ordered = sorted(found.items())
        for low in range(0, len(ordered), ROWS):
            part = ordered[low : low + ROWS]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(part), pa.string()),
                    pa.array([g for g, _ in part], pa.binary()),
                    pa.array([n for _, n in part], pa.int64()),
                ],
                names=["lang", "gram", "n"],
            )

    def count(found: Callable[[str], Counter[bytes]], parts: list[tuple[str, bytes, int]]) -> None:
        words = _Words(parts)
        go_on = words.joined & prefilter.in_table(table.value, (words.pair & np.uint64(BITS - 1)).view(np.int64))
        size, reach = np.ones(len(go_on), np.int64), go_on
        for step in range(1, LONGEST):
            size += reach
            reach = reach & np.append(go_on[step:], np.zeros(min(step, len(go_on)), bool))
        listed = words.raw.split()
        for k, (name, _, _) in enumerate(parts):
            own = found(name)
            low, high = words.first[k], words.first[k + 1]
            mine, sizes = words.own[low:high], size[low:high]
            own.update([listed[low + i] for i in np.flatnonzero(mine & (sizes == 1))])
            longer = np.flatnonzero(mine & (sizes > 1))
            own.update(
                [b" ".join(listed[i : i + n]) for i, n in zip((longer + low).tolist(), sizes[longer].tolist())]
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, Counter[bytes]] = {}
        with np.errstate(over="ignore"):
            for parts in _chunks(batches):
                count(lambda name: langs.setdefault(name, Counter()), parts)
                if sum(map(len, langs.values())) >= HELD:
                    for name, found in langs.items():
                        yield from batches_of(name, found)
                    langs = {}
            for name, found in langs.items():
                yield from batches_of(name, found)

    return _body(docs, text, lang).mapInArrow(run, "lang string, gram binary, n long")


def _flow(min_count: int):
    """Adds weights up along sorted windows: (lang, phrase, length, n) of the phrases found at
    least ``min_count`` times, partial counts at both ends, and length 0 for the language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, bytes, int, int]] = []
        path: list[list] = []  # open nodes by length: [phrase with a space behind it, count]
        lang, head = None, b""  # head: the first window of the partition, while in its language

        def close(keep: int, last: bool) -> None:
            while len(path) > keep:
                phrase, n = path.pop()
                if path:
                    path[-1][1] += n
                if n >= min_count or last or not path or head.startswith(phrase):
                    out.append((lang, _unescape(phrase[:-1]), len(path), n))

        def emit() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            kinds = (pa.string(), pa.binary(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                names=["lang", "phrase", "length", "n"],
            )

        for batch in batches:
            names = batch.column("lang").to_pylist()
            for name, gram, n in zip(names, batch.column("gram").to_pylist(), batch.column("n").to_pylist()):
                gram += b" "
                if name != lang:
                    close(0, False)
                    head = gram if lang is None else b""
                    lang = name
                    path.append([b"", 0])
                elif gram != path[-1][0]:
                    common = len(path)
                    while not gram.startswith(path[common - 1][0]):
                        common -= 1
                    close(common, False)
                at = len(path[-1][0])
                while at < len(gram):
                    at = gram.index(b" ", at) + 1
                    path.append([gram[:at], 0])
                path[-1][1] += n
            if len(out) >= ROWS:
                yield emit()
        close(0, True)
        yield emit()

    return run


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, length, n): every phrase of 1 to ``LONGEST`` words found at least
    ``min_count`` times; length 0 has the number of words of the language."""
    stored = store(edges(docs, frequent_pairs(docs, min_count, text, lang), text, lang))
    dealt = stored.repartitionByRange("lang", "gram").sortWithinPartitions("lang", "gram")
    counted = dealt.mapInArrow(_flow(min_count), "lang string, phrase binary, length int, n long")
    return (
        counted.groupBy("lang", F.decode("phrase", "UTF-8").alias("phrase"), "length")
        .agg(F.sum("n").alias("n"))
        .filter((F.col("n") >= min_count) | (F.col("length") == 0))
    )


def _inside(counts: DataFrame) -> DataFrame:
    """(lang, phrase, most): largest count of a phrase that is longer by one word."""
    longer = counts.filter("length > 2").select(
        "lang",
        "n",
        F.explode(
            F.array(
                F.regexp_replace("phrase", "^[^ ]+ ", ""),
                F.regexp_replace("phrase", " [^ ]+$", ""),
            )
        ).alias("phrase"),
    )
    return longer.groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The ``top`` phrases of 2 to ``LONGEST`` words of each language by their weakest cut:
    lang, rank, phrase, a, l, r, n, score."""
    counts = store(phrase_counts(docs, min_count, text, lang))
    totals = counts.filter("length = 0").select("lang", F.col("n").alias("total"))
    whole = (
        counts.filter("length > 1")
        .join(_inside(counts), ["lang", "phrase"], "left")
        .filter(F.col("most").isNull() | (F.col("most") < F.col("n")))
        .select("lang", "phrase", "length", F.col("n").alias("a"))
    )
    words = F.split("phrase", " ")
    cuts = whole.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("cut")).select(
        "lang",
        "phrase",
        "a",
        "cut",
        F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("length") - F.col("cut")), " ").alias("rest"),
    )
    parts = counts.filter(f"length BETWEEN 1 AND {LONGEST - 1}")
    scored = (
        cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
        .join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
        .join(totals, "lang")
        .withColumn(
            "score",
            F.expr(
                "CAST(CAST(1000 AS DECIMAL(4, 0)) * (CAST(a AS DECIMAL(18, 0)) * CAST(total AS DECIMAL(18, 0)))"
                " AS DECIMAL(38, 0)) DIV CAST(CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)) AS DECIMAL(38, 0))"
            ),
        )
    )
    weakest = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "a", "l", "r", F.col("total").alias("n"))).alias("best")
    )
    ranked = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        weakest.select("lang", "phrase", "best.*")
        .withColumn("rank", F.row_number().over(ranked).cast("long"))
        .filter(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
