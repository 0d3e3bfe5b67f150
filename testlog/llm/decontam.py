"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words at the fixed places of a mask; the places between are
ignored, so a substituted word leaves those seeds intact whose mask skips it.  The
seeds of every benchmark item and of every document are joined.  A hit says where the
item would lie in the document; there the two are compared word by word, and the
document is contaminated where ``STRETCH`` successive words of the item (all of a
shorter item) agree in a share of ``THRESHOLD`` or more.

An item shorter than ``STRETCH`` is cut into one block more than it may have differing words, so
that one block is always intact; its seeds are these blocks, which start at fixed places.

Items of fewer than ``TOLERANT`` words must agree in every word; their only seed is the whole item.

Words are runs of letters, digits and underscores in lower case.  One or two words are no
passage: items of fewer than ``MIN_WORDS`` words are not looked for.

Scale: a document row leaves the scan only where its seeds hit a bit table of fixed
size over the benchmark's seeds, together with the words around; so texts are never
shuffled, and the benchmark may have any size, since the join decides behind the table.

Defined results: null texts count as empty; equal items are reported each; rows of
equal id and text give equal reports; an empty table on either side gives an empty
report and drops nothing; a document without an id is dropped like any other, its
reports carry a null id.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testlog.llm import prefilter
from testlog.llm.names import unused
from testlog.operators.durable import store

# Places that count, from the first word of the window.
MASKS = ("11101011", "1101100101", "11001010011")
MIN_WORDS = 3
TOLERANT = 8
STRETCH = 13
# Masks of the blocks of items shorter than STRETCH; documents use those of which there are items.
BLOCK_MASKS = tuple("1" * n for n in range(MIN_WORDS, TOLERANT))
THRESHOLD = 0.8
SLICE_ROWS = 256

WORD = re.compile(r"\w+")
_SALT = np.random.default_rng(20240606).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the end of each text among them."""
    words = [WORD.findall((t or "").lower()) for t in texts]
    flat = [w for ws in words for w in ws]
    hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=False) if flat else np.zeros(0, np.uint64)
    return hashes, np.cumsum([len(ws) for ws in words], dtype=np.int64)


def needed(n_words: int) -> float:
    """Share of an item's stretch that must agree."""
    return THRESHOLD if n_words >= TOLERANT else 1.0


def block_size(n_words: int) -> int:
    """Words of a block of a short item: one more block than words that may differ."""
    if n_words < TOLERANT:
        return n_words
    differ = max(k for k in range(n_words) if (n_words - k) / n_words >= THRESHOLD)
    return n_words // (differ + 1)


def seeds(words: np.ndarray, ends: np.ndarray, masks: tuple[str, ...] = MASKS) -> tuple[np.ndarray, np.ndarray]:
    """(place, seed) of every mask at every place where it fits into one text."""
    sizes = np.diff(ends, prepend=0)
    left = np.repeat(ends, sizes) - np.arange(len(words))  # words from here to the text's end
    places, values = [], []
    with np.errstate(over="ignore"):
        for mask in masks:
            number = (MASKS + BLOCK_MASKS).index(mask)
            n = len(words) - len(mask) + 1
            if n < 1:
                continue
            hashed = np.full(n, number + 1, np.uint64)
            for k, bit in enumerate(mask):
                if bit == "1":
                    hashed = hashed * _SALT[0] + words[k : k + n]
            hashed = (hashed ^ (hashed >> np.uint64(31))) * _SALT[1]
            hashed ^= hashed >> np.uint64(30)
            fits = np.flatnonzero(left[:n] >= len(mask))
            places.append(fits)
            values.append(hashed[fits])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(values).view(np.int64)


def block_seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, seed) of every block of one short item, numbered as among all masks."""
    size = block_size(len(words))
    places, values = seeds(words, np.array([len(words)]), ("1" * size,))
    return places[places % size == 0], values[places % size == 0]


def _slots(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = prefilter.BITS - 1
    return seed & low, (seed >> 32) & low


def item_seeds(benchmark: DataFrame, item_col: str = "item_id") -> DataFrame:
    """(item_id, item_key, n_words, words, seeds) of the items that are long enough."""
    body = benchmark.select(
        F.col(item_col).cast("long").alias("item_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col(item_col).cast("long"), F.col("text").cast("string")).alias("item_key"),
    ).dropDuplicates(["item_key"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, key, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "item_key", "text"))):
                words, ends = word_hashes([text])
                if len(words) >= MIN_WORDS:
                    place, seed = seeds(words, ends) if len(words) >= STRETCH else block_seeds(words)
                    hits = [{"place": p, "seed": s} for p, s in zip(place.tolist(), seed.tolist())]
                    rows.append((item, key, len(words), words.tobytes(), hits))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.binary()),
                    pa.array(columns[4], pa.list_(pa.struct([("place", pa.int64()), ("seed", pa.int64())]))),
                ],
                names=["item_id", "item_key", "n_words", "words", "seeds"],
            )

    return body.mapInArrow(
        run, "item_id long, item_key long, n_words long, words binary, seeds array<struct<place:long,seed:long>>"
    )


def _passages(docs: DataFrame, table: np.ndarray, reach: int, masks: tuple[str, ...], id_col: str) -> DataFrame:
    """Stretches of documents around seeds that the bit table knows."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    body = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(id_col).cast("long"), F.col("text").cast("string")).alias("row_key"),
        F.col("text").cast("string").alias("text"),
    )
    hit_type = pa.list_(pa.struct([("place", pa.int64()), ("seed", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                words, ends = word_hashes(part.column("text").to_pylist())
                place, seed = seeds(words, ends, masks)
                one, two = _slots(seed)
                known = prefilter.in_table(shared.value, one)
                known[known] = prefilter.in_table(shared.value, two[known])
                place, seed = place[known], seed[known]
                order = np.argsort(place, kind="stable")
                place, seed = place[order], seed[order]
                doc = np.searchsorted(ends, place, side="right")
                # a new stretch where the words around two hits do not touch
                cut = np.ones(len(place), bool)
                cut[1:] = (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] > 2 * reach)
                heads = np.flatnonzero(cut)
                rows = []
                for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(place)]):
                    k = int(doc[a])
                    begin = int(ends[k - 1]) if k else 0
                    low = max(begin, int(place[a]) - reach)
                    high = min(int(ends[k]), int(place[b - 1]) + reach)
                    hits = [{"place": int(p) - low, "seed": int(s)} for p, s in zip(place[a:b], seed[a:b])]
                    rows.append((k, low - begin, words[low:high].tobytes(), hits))
                columns = list(zip(*rows)) if rows else [(), (), (), ()]
                whose = pa.array(columns[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(whose),
                        part.column("row_key").take(whose),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.binary()),
                        pa.array(columns[3], hit_type),
                    ],
                    names=["doc_id", "row_key", "first_word", "words", "hits"],
                )

    return body.mapInArrow(
        run,
        "doc_id long, row_key long, first_word long, words binary, hits array<struct<place:long,seed:long>>",
    )


def overlap(item: np.ndarray, text: np.ndarray, shift: int) -> tuple[int, int, float]:
    """Best stretch of the item laid at ``shift`` in the text: (first word, words, share)."""
    n = min(len(item), STRETCH)
    low, high = max(0, -shift), min(len(item), len(text) - shift)
    if high - low < n:
        return 0, n, 0.0
    same = np.zeros(high - low + 1, np.int64)
    np.cumsum(item[low:high] == text[low + shift : high + shift], out=same[1:])
    sums = same[n:] - same[:-n]
    best = int(np.argmax(sums))
    return low + best, n, float(sums[best]) / n


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, row_key, first_word, n_words, share."""
    items = store(item_seeds(benchmark, item_col))
    low = F.lit(prefilter.BITS - 1).cast("long")
    item_hits = items.select("item_key", F.explode("seeds").alias("at")).select("item_key", "at.place", "at.seed")
    both = item_hits.select(
        F.explode(F.array(F.col("seed").bitwiseAND(low), F.shiftright("seed", 32).bitwiseAND(low))).alias("slot")
    )
    table = prefilter.bit_table(both)
    reach = items.agg(F.max("n_words")).first()[0]
    short = items.filter(F.col("n_words") < STRETCH).select("n_words").distinct().collect()  # ten numbers at most
    masks = MASKS + tuple(sorted({"1" * block_size(r.n_words) for r in short}))
    found = store(_passages(docs, table, int(reach or 0), masks, id_col).withColumn("passage", F.xxhash64("row_key", "first_word", "words")))
    laid = (
        found.select("passage", F.explode("hits").alias("hit"))
        .select("passage", F.col("hit.place").alias("text_place"), F.col("hit.seed").alias("seed"))
        .join(item_hits, "seed")
        .select("passage", "item_key", (F.col("text_place") - F.col("place")).alias("shift"))
        .distinct()
    )
    sides = (
        laid.join(found.select("passage", "doc_id", "row_key", "first_word", "words").dropDuplicates(["passage"]), "passage")
        .join(items.select("item_key", "item_id", F.col("words").alias("item_words")), "item_key")
        .select("doc_id", "row_key", "item_id", "first_word", "shift", "words", "item_words")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, counts, shares = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("first_word", "shift", "words", "item_words"))
            for first, shift, words, item in zip(*columns):
                at, n, share = overlap(np.frombuffer(item, np.uint64), np.frombuffer(words, np.uint64), shift)
                starts.append(first + shift + at)
                counts.append(n)
                shares.append(share)
            keep = pa.array([s >= needed(n) for s, n in zip(shares, counts)], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), batch.column("item_id"),
                 pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(shares, pa.float64())],
                names=["doc_id", "row_key", "item_id", "first_word", "n_words", "share"],
            ).filter(keep)

    verified = sides.mapInArrow(
        run, "doc_id long, row_key long, item_id long, first_word long, n_words long, share double"
    )
    # of several places in one document the earliest stands for them
    return verified.groupBy("doc_id", "row_key", "item_id").agg(
        F.min("first_word").alias("first_word"), F.max("n_words").alias("n_words"), F.max("share").alias("share")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that overlap with no benchmark item."""
    row = unused(docs.columns, "__row")
    bad = store(contaminated(docs, benchmark, id_col).select(F.col("row_key").alias(row)).distinct())
    key = F.xxhash64(F.col(id_col).cast("long"), F.col("text").cast("string"))
    return docs.withColumn(row, key).join(bad, row, "left_anti").drop(row)
