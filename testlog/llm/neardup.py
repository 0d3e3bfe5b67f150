"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is a sequence of lower-cased words.  Its shingles are all runs of five words,
each labelled with its occurrence number, so that repeats count.  Each of ``SKETCHES``
hash functions picks the ``PICKED`` shingles with the least hashes; the key of the
sketch is made of these in text order, so it is equal only where the shingles are
shared *and* stand in the same order.  Documents that share a key are compared by a
banded word alignment; those of similarity 0.8 or more (1 - edits / longer length) are
linked, and classes are the connected components over links.

Scale: equal texts are one node.  Within a key, members are first compared with one leader
(the least id), for a few sketches and then, where they are not in its component yet, for the
others; this settles families of like texts with few comparisons for each member.  Then every two
other members that are still in different components are compared.  Keys of up to
``JOINED`` members are joined with themselves.  A larger key is cut into bands of length, outside
of which no two texts are similar, and a band into blocks of some ``BLOCK_WORDS`` words; every two
blocks of a band meet in one task, which gives out only links: a pair
is rejected exactly by the words it shares (an edit takes away one at most), is aligned at the
least of its common keys only, and not at all once its components have met in that task.  A pair
that shares a key is thus either aligned, or rejected by such a bound, or in one component; none
is dropped by a cap.  Found links are contracted to pairs of components before components are
joined further.  Leaders are found by pre-aggregated minima; keys never gather their members in
one task.  ``n_links`` counts the links found this way: they connect a class, links between
members of one component are not looked for.

Defined results: a null text counts as empty; texts with equal words in equal order
and equal spelling but for case and spacing have equal keys; a text of fewer than
five words has one shingle, all its words; texts without words only match equal texts;
rows of one id form one document (of different texts, the one of the least hash); rows without an id take part in classes of equal
texts only, and are kept as rows of their own in ``drop_near_duplicates``; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from testlog.llm import prefilter
from testlog.llm.align import similarity
from testlog.llm.components import components
from testlog.llm.names import unused
from testlog.operators.durable import any_row, store

SHINGLE = 5
SKETCHES = 80
PICKED = 3
THRESHOLD = 0.8
SLICE_ROWS = 256  # documents hashed at once
CELLS = 1 << 21  # hashes held at once
FIRST_SKETCHES = 6  # sketches whose leaders are met before all others
JOINED = 64  # members up to which a key is joined with itself
BLOCK_WORDS = 1 << 19  # words of one block of a larger key

_ODD = np.random.default_rng(20240817).integers(1, 1 << 63, SKETCHES + 8, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """64-bit hash of every lower-cased word of each text."""
    words = [(t or "").lower().split() for t in texts]
    flat = [w for ws in words for w in ws]
    hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=False) if flat else np.zeros(0, np.uint64)
    ends = np.cumsum([len(ws) for ws in words])
    return np.split(hashes, ends[:-1]) if len(words) else []


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles in text order."""
    n = len(words) - SHINGLE + 1
    if not len(words):
        return np.zeros(0, np.uint64)
    if n < 1:
        rolled = np.zeros(1, np.uint64)
        for w in words:
            rolled = rolled * _ODD[0] + w
    else:
        rolled = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            rolled = rolled * _ODD[0] + words[k : k + n]
    rolled = mix(rolled)
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    again = np.zeros(len(ranked), bool)
    again[1:] = ranked[1:] == ranked[:-1]
    if again.any():
        place = np.arange(len(ranked))
        first = np.maximum.accumulate(np.where(again, 0, place))
        label = np.empty(len(ranked), np.uint64)
        label[order] = (place - first).astype(np.uint64)
        rolled = mix(rolled + label * _ODD[1])
    return rolled


def sketch(words: np.ndarray) -> np.ndarray:
    """One key per hash function; none for a text without words."""
    grams = shingles(words)
    if not len(grams):
        return np.zeros(0, np.int64)
    keys = np.empty(SKETCHES, np.uint64)
    picked = min(PICKED, len(grams))
    # all functions side by side, for very long texts a few at a time
    together = max(1, min(SKETCHES, CELLS // len(grams)))
    for low in range(0, SKETCHES, together):
        odd = _ODD[8 + low : 8 + min(low + together, SKETCHES)]
        hashed = ((grams[None, :] * odd[:, None]) >> np.uint64(32)).astype(np.uint32)
        rows = np.arange(len(odd))
        at = np.empty((len(odd), picked), np.int64)
        for k in range(picked):
            at[:, k] = hashed.argmin(axis=1)
            hashed[rows, at[:, k]] = 0xFFFFFFFF
        at.sort(axis=1)
        key = np.arange(low + 1, low + len(odd) + 1, dtype=np.uint64)
        for k in range(picked):
            key = key * _ODD[3] + grams[at[:, k]]
        keys[low : low + len(odd)] = key
    return mix(keys).view(np.int64)


def _sketches(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, text_hash, n_words, keys) of every row."""
    body = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("text_hash", F.unhex(F.sha2("text", 256)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for first in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(first, SLICE_ROWS)
                    words = word_hashes(part.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("id"),
                            part.column("text_hash"),
                            pa.array([len(w) for w in words], pa.int64()),
                            pa.array([sketch(w) for w in words], pa.list_(pa.int64())),
                        ],
                        names=["id", "text_hash", "n_words", "keys"],
                    )

    return body.mapInArrow(run, "id long, text_hash binary, n_words long, keys array<long>")


def _tokens(docs: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """(id, tokens) of the documents in ``wanted(id)``, tokens as packed 32-bit word hashes."""
    table = docs.sparkSession.sparkContext.broadcast(
        prefilter.bit_table(wanted.select(prefilter.slot("id").alias("slot")))
    )
    body = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).select("id", "text", prefilter.slot("id").alias("slot"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = prefilter.in_table(table.value, batch.column("slot").to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(keep))
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                words = word_hashes(part.column("text").to_pylist())
                packed = [(w >> np.uint64(32)).astype("<u4").tobytes() for w in words]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(packed, pa.binary())], names=["id", "tokens"]
                )

    # rows of one id are one document: the least token string stands for it
    return body.filter(F.col("id").isNotNull()).mapInArrow(run, "id long, tokens binary")


def _verify(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(leader, id, similarity) of ``pairs(leader, id)``; similarity is 0 below the threshold."""
    sides = pairs.join(tokens, "id").withColumnRenamed("tokens", "mine")
    sides = sides.join(tokens.select(F.col("id").alias("leader"), "tokens"), "leader")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                similarity(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), THRESHOLD)
                for a, b in zip(batch.column("mine").to_pylist(), batch.column("tokens").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("leader"), batch.column("id"), pa.array(found, pa.float64())],
                names=["leader", "id", "similarity"],
            )

    return sides.select("leader", "id", "mine", "tokens").mapInArrow(
        run, "leader long, id long, similarity double"
    )


def _extended(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, label) after the links ``found(a, b)``, which are contracted to pairs of labels first."""
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if labels is None:
        return components(found)
    known = store(labels.join(ends, "node", "full").select("node", F.coalesce("label", "node").alias("label")))
    pairs = (
        found.join(known.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
        .join(known.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        .filter("x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    merged = components(pairs).select(F.col("node").alias("label"), F.col("label").alias("merged"))
    return store(known.join(merged, "label", "left").select("node", F.coalesce("merged", "label").alias("label")))


def _apart(met: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows (id, leader, ...) whose two documents are not in one component."""
    if labels is None:
        return met
    mine = labels.select(F.col("node").alias("id"), F.col("label").alias("mine"))
    theirs = labels.select(F.col("node").alias("leader"), F.col("label").alias("theirs"))
    both = met.join(mine, "id", "left").join(theirs, "leader", "left")
    return both.filter(F.coalesce("mine", "id") != F.coalesce("theirs", "leader")).drop("mine", "theirs")


def _open_members(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, n_words, label, size, total) of the keys whose members are in several components."""
    known = labels.select(F.col("node").alias("id"), "label")
    labelled = met.select("key", "id", "n_words").join(known, "id", "left").withColumn("label", F.coalesce("label", "id"))
    keys = labelled.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.sum("n_words").alias("total")
    )
    return labelled.join(keys.filter("low < high").select("key", "size", "total"), "key")


def _joined_pairs(members: DataFrame) -> DataFrame:
    """Pairs (leader, id) of small keys that are not in one component."""
    s, p = members.alias("s"), members.alias("p")
    # lengths too far apart cannot be similar, so only close ones are aligned
    close = F.least("s.n_words", "p.n_words") >= THRESHOLD * F.greatest("s.n_words", "p.n_words") - 1e-9
    meet = (F.col("s.key") == F.col("p.key")) & (F.col("s.id") < F.col("p.id")) & (F.col("s.label") != F.col("p.label"))
    return s.join(p, meet & close).select(F.col("s.id").alias("leader"), F.col("p.id").alias("id")).distinct()


def _labelled(words: np.ndarray) -> np.ndarray:
    """Each word with its occurrence number, as one number, in any order."""
    ranked = np.sort(words)
    place = np.arange(len(ranked))
    again = np.zeros(len(ranked), bool)
    again[1:] = ranked[1:] == ranked[:-1]
    first = np.maximum.accumulate(np.where(again, 0, place))
    return ranked.astype(np.int64) << 32 | (place - first)


def block_links(key: int, across: bool, rows: list[dict]) -> list[tuple[int, int]]:
    """Links (a, b) that join the components of one unit's rows (id, label, block, guest, tokens, keys).

    ``across``: the unit holds two blocks, and only pairs with one document in each count.
    Pairs of two guests meet in the guests' own band.
    """
    words = [np.frombuffer(r["tokens"], "<u4") for r in rows]
    keys = [np.array(r["keys"], np.int64) for r in rows]
    ids = np.array([r["id"] for r in rows])
    blocks = np.array([r["block"] for r in rows])
    guest = np.array([r["guest"] for r in rows])
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    marked, places = np.unique(np.concatenate([_labelled(w) for w in words]), return_inverse=True)
    present = np.zeros(len(marked), bool)
    _, component = np.unique([r["label"] for r in rows], return_inverse=True)
    found = []
    for x in range(len(rows) - 1):
        others = (component != component[x]) & (ids != ids[x])
        others[: x + 1] = False
        if across:
            others &= blocks != blocks[x]
        if guest[x]:
            others &= ~guest
        longer = np.maximum(sizes, sizes[x])
        limit = ((1.0 - THRESHOLD) * longer + 1e-9).astype(np.int64)
        others &= longer - np.minimum(sizes, sizes[x]) <= limit
        if not others.any():
            continue
        mine = places[starts[x] : starts[x] + sizes[x]]
        present[mine] = True
        # an edit takes away one common word at most
        shared = np.add.reduceat(present[places[starts[x + 1] :]], starts[x + 1 :] - starts[x + 1], dtype=np.int64)
        present[mine] = False
        others[x + 1 :] &= longer[x + 1 :] - shared <= limit[x + 1 :]
        for y in np.flatnonzero(others).tolist():
            if component[y] == component[x] or np.intersect1d(keys[x], keys[y], assume_unique=True)[0] != key:
                continue
            if similarity(words[x], words[y], THRESHOLD) > 0:
                component[component == component[y]] = component[x]
                found.append((min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))))
    return found


def _banded(members: DataFrame) -> DataFrame:
    """Members of large keys dealt to bands of length, with each band's ``total`` of words.

    A band holds lengths up to twice its least, and as guests the longer documents that may be
    similar to one of those; two similar documents so meet in the band of the shorter one.
    Bands of one component are left out.
    """
    own = F.length(F.bin("n_words"))
    shortest = F.col("n_words") - F.floor((1.0 - THRESHOLD) * F.col("n_words") + 1e-9)
    below = F.pow(F.lit(2.0), own - 1) - 1
    mine = members.select("key", "id", "n_words", "label", own.alias("band"))
    used = mine.select("key", "band").distinct()  # nobody is a guest where no band is
    guests = mine.filter(shortest <= below).withColumn("band", F.col("band") - 1).join(used, ["key", "band"], "left_semi")
    dealt = mine.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    open_bands = dealt.groupBy("key", "band").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.sum("n_words").alias("total")
    )
    return dealt.join(open_bands.filter("low < high").select("key", "band", "total"), ["key", "band"])


def _block_links(members: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links (a, b) within large keys."""
    keys = members.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # SKETCHES at most
    blocks = F.ceil(F.col("total") / BLOCK_WORDS).cast("int")
    dealt = (
        _banded(members)
        .withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "key", "band", "id", "label", "guest", "block",
            F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
        )
    )
    rows = dealt.join(keys.join(tokens, "id"), "id")  # both meet once per document, not once per unit

    def run(key: tuple, table: pa.Table) -> pa.Table:
        unit = table.select(["id", "label", "block", "guest", "tokens", "keys"]).to_pylist()
        found = block_links(key[0].as_py(), key[2] != key[3], unit)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("key", "band", "one", "two").applyInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b), a < b, between the nodes(id, n_words, keys), and the labels
    (node, label) of their components.

    Any two nodes that share a key and have similarity ``THRESHOLD`` or more are in one
    component; a link within a component would not change the classes and is not looked for.
    """
    spark = docs.sparkSession
    members = nodes.select("id", "n_words", F.posexplode("keys").alias("number", "key"))
    leaders = members.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("size"))
    leaders = leaders.filter("size > 1").select("key", "leader")
    met = members.join(leaders, "key").filter(F.col("id") > F.col("leader"))
    met = store(met.select("key", "number", "id", "n_words", "leader"))
    if not any_row(met):
        none = spark.range(0)
        return none.select(F.col("id").alias("a"), F.col("id").alias("b")), none.select(
            F.col("id").alias("node"), F.col("id").alias("label")
        )
    sizes = nodes.select(F.col("id").alias("leader"), F.col("n_words").alias("leader_words"))
    longer = F.greatest("n_words", "leader_words")
    # whoever meets in a later block has met a leader
    wanted = met.select(F.explode(F.array("leader", "id")).alias("id"))
    tokens = store(_tokens(docs, id_col, wanted).groupBy("id").agg(F.min("tokens").alias("tokens")))
    found, labels = None, None

    def add(new: DataFrame) -> None:
        nonlocal found, labels
        found = new if found is None else found.unionByName(new)
        if labels is None or any_row(new):
            labels = _extended(labels, new)

    def verified(pairs: DataFrame) -> DataFrame:
        near = _verify(pairs, tokens).filter("similarity > 0")
        return store(near.select(F.col("leader").alias("a"), F.col("id").alias("b")))

    for some in (F.col("number") < FIRST_SKETCHES, F.col("number") >= FIRST_SKETCHES):
        pairs = _apart(met.filter(some).select("leader", "id", "n_words").distinct(), labels).join(sizes, "leader")
        close = F.least("n_words", "leader_words") >= THRESHOLD * longer - 1e-9
        add(verified(pairs.filter(close).select("leader", "id")))
    # a leader has been compared with the whole key, so it is done there
    members = store(_open_members(met, labels))
    add(verified(_joined_pairs(members.filter(F.col("size") <= JOINED))))
    add(store(_block_links(members.filter(F.col("size") > JOINED), tokens)))
    return found, labels


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, class_id (least id of the class), n_links, is_kept."""
    rows = store(_sketches(docs, id_col))
    texts = store(
        rows.groupBy("text_hash").agg(
            F.min("id").alias("node"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys")
        )
    )
    nodes = texts.filter(F.col("node").isNotNull()).select(F.col("node").alias("id"), "n_words", "keys")
    found, labels = links(docs, nodes, id_col)
    degrees = (
        found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    )
    labelled = store(
        texts.select("text_hash", "node")
        .join(labels, "node", "left")
        .join(degrees, "node", "left")
        .select("text_hash", F.coalesce("label", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    return rows.select("id", "text_hash").join(labelled, "text_hash").select(
        F.col("id").alias(id_col), "class_id", "n_links", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("is_kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without those that have a near or equal copy of a smaller id."""
    classes = near_duplicate_classes(docs, id_col)
    mark = unused(docs.columns, "__kept")
    kept = classes.filter(F.col("is_kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias(mark)).distinct()
    # rows of one id are one document: the least text stands for it
    first = Window.partitionBy(F.col(id_col)).orderBy(F.xxhash64("text"), F.col("text"))
    named = docs.join(kept, F.col(id_col) == F.col(mark)).withColumn(mark, F.row_number().over(first))
    named = named.filter(F.col(mark) == 1).drop(mark)
    return named.unionByName(docs.filter(F.col(id_col).isNull()))
