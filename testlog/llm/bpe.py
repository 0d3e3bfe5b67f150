"""Byte-level BPE encoding and decoding.

Texts become arrays of code points, code points become classes, and the places where
a pre-token starts are found by a scan over transition functions: each class maps
every scanner state to its successor, a stretch of text is the composition of its
characters' functions, and compositions are associative, so stretches are composed
side by side, then joined, then replayed from their known entry states.  No regular
expression runs.  The resulting slices are looked up in a bounded cache; slices that
are not in it are merged together, many at a time.

Encoded form: ``ids`` and ``ends`` are packed little-endian unsigned 32-bit numbers;
``ends`` holds, for every token, the byte position in the text where it ends.

Defined results: a null text counts as empty; an empty text gives no tokens and
decodes to no bytes; repeated rows give repeated rows; an empty table gives an empty
table; other columns are carried unless an output column has their name.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from testlog.functions.text import WHITE_SPACE

# Character classes after a look at the following characters.
LETTER, NUMBER, OTHER, APOS2, APOS3, SPACE_IN, BLANK_LAST, SPACE_LAST, BREAK = range(9)
CLASSES = 9
# Scanner states: what the characters read so far leave open.
START, AFTER_BLANK, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8

# What may follow an apostrophe in one pre-token.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")

WINDOW = 1 << 19  # characters scanned at once
STRETCH = 512  # characters of one composed function
CACHE_SLICES = 300_000
LONG_SLICE = 64  # bytes from which a slice is merged by a heap


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Successor and "a pre-token starts here" for every (class, state)."""
    begin = {
        LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOS2: ONE_LEFT, APOS3: TWO_LEFT,
        SPACE_IN: IN_SPACE, BLANK_LAST: AFTER_BLANK, SPACE_LAST: START, BREAK: START,
    }
    goes_on = {
        IN_LETTERS: {LETTER}, IN_NUMBERS: {NUMBER}, IN_OTHERS: {OTHER, APOS2, APOS3}, IN_SPACE: {SPACE_IN},
    }
    after_blank = {
        LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOS2: IN_OTHERS, APOS3: IN_OTHERS,
    }
    follow = np.zeros((CLASSES, STATES), np.intp)
    starts = np.zeros((CLASSES, STATES), bool)
    for kind in range(CLASSES):
        for state in range(STATES):
            if kind == BREAK:
                follow[kind, state], starts[kind, state] = START, True
            elif state == TWO_LEFT:
                follow[kind, state] = ONE_LEFT
            elif state == ONE_LEFT:
                follow[kind, state] = START
            elif state == AFTER_BLANK and kind in after_blank:
                follow[kind, state] = after_blank[kind]
            elif kind in goes_on.get(state, ()):
                follow[kind, state] = state
            else:
                follow[kind, state], starts[kind, state] = begin[kind], True
    return follow, starts


FOLLOW, STARTS = _transitions()
_CLASS_OF: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """Class of every code point by its general category; white space is SPACE_IN."""
    if not _CLASS_OF:
        kinds = {"L": LETTER, "N": NUMBER}
        category = unicodedata.category
        table = np.fromiter(
            (kinds.get(category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000
        )
        table[[ord(c) for c in WHITE_SPACE]] = SPACE_IN
        _CLASS_OF.append(table)
    return _CLASS_OF[0]


def classify(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Class of each code point, refined by the next ones; ``breaks`` end texts."""
    kinds = class_table()[points]
    kinds[breaks] = BREAK
    following = np.empty_like(kinds)
    following[:-1] = kinds[1:]
    following[-1:] = BREAK
    last = (kinds == SPACE_IN) & (following != SPACE_IN) & (following != BREAK)
    blank = points == 0x20
    kinds[last & blank] = BLANK_LAST
    kinds[last & ~blank] = SPACE_LAST
    marks = np.flatnonzero(points == 0x27)
    marks = marks[(marks + 1 < len(points)) & (kinds[marks] != BREAK)]
    if len(marks):
        one = points[marks + 1]
        two = points[np.minimum(marks + 2, len(points) - 1)]
        inside = (marks + 2 < len(points)) & (kinds[marks + 1] != BREAK)
        short = np.isin(one, [ord(c) for c in SHORT_ENDINGS]) & (kinds[marks + 1] != BREAK)
        kinds[marks[short]] = APOS2
        for pair in LONG_ENDINGS:
            hit = inside & (one == ord(pair[0])) & (two == ord(pair[1])) & ~short
            kinds[marks[hit]] = APOS3
    return kinds


def scan(kinds: np.ndarray) -> np.ndarray:
    """Positions where a pre-token starts; the text starts in state START."""
    n = len(kinds)
    rows = -(-n // STRETCH)
    grid = np.full(rows * STRETCH, BREAK, np.uint8)
    grid[:n] = kinds
    columns = np.ascontiguousarray(grid.reshape(rows, STRETCH).T).astype(np.intp) * STATES
    flat = FOLLOW.reshape(-1)
    # the function of every stretch: its end state for each start state
    ends = np.tile(np.arange(STATES), (rows, 1))
    for column in columns:
        ends = flat[ends + column[:, None]]
    # prefix compositions by doubling
    step = 1
    while step < rows:
        joined = ends.copy()
        joined[step:] = np.take_along_axis(ends[step:], ends[:-step], axis=1)
        ends = joined
        step *= 2
    state = np.full(rows, START, np.intp)
    state[1:] = ends[:-1, START]
    starts = np.empty((STRETCH, rows), bool)
    marks = STARTS.reshape(-1)
    for k, column in enumerate(columns):
        at = column + state
        starts[k] = marks[at]
        state = flat[at]
    return np.flatnonzero(np.ascontiguousarray(starts.T).reshape(-1)[:n])


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks from a file of "base64 rank" lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merger:
    """Pair merging by rank, with a bounded cache of whole slices."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.base = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.size = size
        lengths = np.fromiter(map(len, self.tokens), np.int64, size)
        self.lengths = lengths
        self.token_starts = np.cumsum(lengths) - lengths
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.cache: dict[str, bytes] = {}

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted pairs of tokens whose bytes together are a token, and that token; only encoding asks."""
        ranks, size = self.ranks, self.size
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left * size + right] = rank
        keys = np.array(sorted(found), np.int64)
        return keys, np.array([found[k] for k in keys.tolist()], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or ``size`` where the pair is no token."""
        keys, values = self.pairs
        key = left * self.size + right
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        return np.where(keys[at] == key, values[at], self.size)

    def _merge_long(self, piece: bytes) -> bytes:
        """One long slice: the best pair from a heap, the leftmost of equals first."""
        ids = self.base[np.frombuffer(piece, np.uint8)].tolist()
        n, none = len(ids), self.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens, ranks = self.tokens, self.ranks

        def rank(a: int, b: int) -> int:
            return ranks.get(tokens[ids[a]] + tokens[ids[b]], none)

        heap = [(r, i) for i in range(n - 1) if (r := rank(i, i + 1)) != none]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank(i, j) != r:
                continue  # one side has been merged since
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(i, k)) != none:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank(h, i)) != none:
                heapq.heappush(heap, (r, h))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each slice.  Short slices go together, one merge per slice and round."""
        out: list[bytes] = [b""] * len(pieces)
        short = []
        for k, piece in enumerate(pieces):
            if len(piece) > LONG_SLICE:
                out[k] = self._merge_long(piece)
            else:
                short.append(k)
        lengths = np.fromiter((len(pieces[k]) for k in short), np.int64, len(short))
        names = np.array(short, np.int64)[lengths > 0]
        lengths = lengths[lengths > 0]
        if not len(names):
            return out
        ids = self.base[np.frombuffer(b"".join([pieces[k] for k in names.tolist()]), np.uint8)]
        none = self.size

        def pair_ranks(ids: np.ndarray, heads: np.ndarray) -> np.ndarray:
            ranks = np.full(len(ids), none, np.int64)
            ranks[:-1] = self._rank(ids[:-1], ids[1:])
            ranks[heads[1:] - 1] = none  # the last token of a slice has no pair
            return ranks

        heads = np.cumsum(lengths) - lengths
        ranks = pair_ranks(ids, heads)
        while True:
            best = np.minimum.reduceat(ranks, heads)
            done = best == none
            if done.any():
                packed = ids.astype("<u4").tobytes()
                for k, a, m in zip(names[done].tolist(), heads[done].tolist(), lengths[done].tolist()):
                    out[k] = packed[4 * a : 4 * (a + m)]
                left = ~done
                if not left.any():
                    return out
                keep = np.repeat(left, lengths)
                ids, ranks = ids[keep], ranks[keep]
                names, lengths, best = names[left], lengths[left], best[left]
                heads = np.cumsum(lengths) - lengths
            # the leftmost place of the best rank in each slice
            hits = np.flatnonzero(ranks == np.repeat(best, lengths))
            owner = np.searchsorted(heads, hits, side="right") - 1
            first = np.ones(len(hits), bool)
            first[1:] = owner[1:] != owner[:-1]
            at = hits[first]
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            shift = np.cumsum(keep) - 1
            ids, ranks = ids[keep], ranks[keep]
            at = shift[at]
            lengths = lengths - 1
            heads = np.cumsum(lengths) - lengths
            last = heads + lengths - 1
            ends = at == last
            ranks[at] = none
            inner = at[~ends]
            ranks[inner] = self._rank(ids[inner], ids[inner + 1])
            back = at[at > heads]
            ranks[back - 1] = self._rank(ids[back - 1], ids[back])

    def encode_slices(self, slices: list[str]) -> list[bytes]:
        cache = self.cache
        found = list(map(cache.get, slices))
        if None in found:
            missing = list({s for s, ids in zip(slices, found) if ids is None})
            merged = dict(zip(missing, self.merge([s.encode() for s in missing])))
            found = [merged[s] if ids is None else ids for s, ids in zip(slices, found)]
            if len(cache) + len(merged) > CACHE_SLICES:
                cache.clear()
            if len(merged) <= CACHE_SLICES:
                cache.update(merged)
        return found

    def encode_texts(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text; texts are scanned together, WINDOW characters at a time."""
        group: list[str] = []
        size = 0
        for text in texts:
            if size and size + len(text) > WINDOW:
                yield from self._encode_group(group)
                group, size = [], 0
            if len(text) > WINDOW:
                yield self._encode_long(text)
                continue
            group.append(text)
            size += len(text) + 1
        if group:
            yield from self._encode_group(group)

    def _slices(self, text: str, breaks: np.ndarray) -> tuple[list[str], np.ndarray]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = scan(classify(points, breaks))
        stops = np.append(starts[1:], len(text))
        return [text[a:b] for a, b in zip(starts.tolist(), stops.tolist())], starts

    def _encode_group(self, texts: list[str]) -> Iterator[bytes]:
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # where the break after each text stands
        slices, starts = self._slices("\0".join(texts) + "\0", ends)
        at = np.searchsorted(starts, ends).tolist()
        for k in at:
            slices[k] = ""  # the break itself
        ids = self.encode_slices(slices)
        first = 0
        for k in at:
            yield b"".join(ids[first:k])
            first = k + 1

    def _encode_long(self, text: str) -> bytes:
        """A text of any length: each window ends at its last sure start of a pre-token."""
        parts, first, width = [], 0, WINDOW
        while first < len(text):
            whole = first + width >= len(text)
            # three more characters, for what the last ones look ahead
            piece = text[first : first + width + 3]
            slices, starts = self._slices(piece, np.array([], np.intp))
            if not whole:
                sure = int(np.searchsorted(starts, width, side="right")) - 1
                if sure < 1:
                    width *= 2  # one pre-token fills the window
                    continue
                slices = slices[:sure]
                first += int(starts[sure])
            else:
                first = len(text)
            width = WINDOW
            parts.extend(self.encode_slices(slices))
        return b"".join(parts)

    def ends_of(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """Bytes of the tokens, each copied to the place its end offset names."""
        if not len(ids):
            return b""
        sizes = self.lengths[ids]
        source = np.repeat(self.token_starts[ids] - (ends - sizes), sizes)
        source += np.arange(len(source))
        return self.blob[source].tobytes()


_MERGERS: dict[str, Merger] = {}


def _merger(shared) -> Merger:
    """One merger per Python worker and vocabulary."""
    key, ranks = shared.value
    if key not in _MERGERS:
        _MERGERS.clear()
        _MERGERS[key] = Merger(ranks)
    return _MERGERS[key]


def _share(df: DataFrame, path: str):
    """The vocabulary as a broadcast: read once by the driver, bounded by its own size."""
    return df.sparkSession.sparkContext.broadcast((path, read_ranks(path)))


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of a few million bytes each, at least one row."""
    sizes = np.zeros(batch.num_rows, np.int64)
    lengths = pc.binary_length(batch.column(column))
    sizes[:] = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if total and total + size > 2 * WINDOW:
            yield batch.slice(first, k - first)
            first, total = k, 0
        total += size
    if first < batch.num_rows:
        yield batch.slice(first)


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Replace ``text`` by packed ``ids`` and ``ends``."""
    shared = _share(docs, vocabulary)
    carried = [c for c in docs.columns if c not in (text, "ids", "ends")]
    body = docs.select(*carried, docs[text].cast("string").alias(text))
    fields = [f for f in body.schema.fields if f.name != text]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType()), T.StructField("ends", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(shared)
        for batch in batches:
            for part in _pieces(batch, text):
                texts = [t or "" for t in part.column(text).to_pylist()]
                ids = list(merger.encode_texts(texts))
                ends = [merger.ends_of(np.frombuffer(x, "<u4")).astype("<u4").tobytes() for x in ids]
                columns = [part.column(c) for c in carried]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(ids, pa.binary()), pa.array(ends, pa.binary())],
                    names=[*carried, "ids", "ends"],
                )

    return body.mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """Add ``decoded``, the bytes that ``ids`` and ``ends`` stand for."""
    shared = _share(tokens, vocabulary)
    names = [c for c in tokens.columns if c != "decoded"]
    body = tokens.select(*names)
    schema = T.StructType([*body.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(shared)
        for batch in batches:
            for part in _pieces(batch, "ids"):
                decoded = [
                    merger.decode(np.frombuffer(i or b"", "<u4"), np.frombuffer(e or b"", "<u4").astype(np.int64))
                    for i, e in zip(part.column("ids").to_pylist(), part.column("ends").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(decoded, pa.binary())], names=[*names, "decoded"]
                )

    return body.mapInArrow(run, schema)
