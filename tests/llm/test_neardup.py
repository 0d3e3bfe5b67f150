import random

import numpy as np
import pytest

from testlog.llm import neardup
from testlog.llm.align import banded_distance, similarity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_is_the_edit_distance():
    rng = random.Random(4)
    for _ in range(3000):
        size = rng.choice([2, 3, 8])
        a = [rng.randrange(size) for _ in range(rng.randint(0, 16))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            place = rng.randint(0, len(b))
            b[place : place + rng.randint(0, 1)] = [rng.randrange(size)] * rng.randint(0, 1)
        limit = rng.randint(0, 18)
        got = banded_distance(np.array(a, np.int64), np.array(b, np.int64), limit)
        assert got == min(distance(a, b), limit + 1)
    assert similarity(np.zeros(0), np.zeros(0), 0.8) == 1.0


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, texts = [], {}
    number = 0

    def add(words):
        nonlocal number
        texts[number] = " ".join(words)
        number += 1

    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 200))]
        for copy in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(copy * len(base) // 100):
                words[rng.randrange(len(words))] = word()
            add(words)
        add(base)  # an exact copy
        add(base[: len(base) // 2])  # too short to be similar
    shared = [word() for _ in range(30)]
    for _ in range(25):  # one passage in unlike documents
        add([word() for _ in range(60)] + shared + [word() for _ in range(60)])
    for text in ("", "one", "one two", "One  two"):
        add(text.split(" "))
    docs = list(texts.items())
    return docs, texts


def brute(texts):
    label = {d: d for d in texts}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    items = sorted(texts.items())
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            u, v = x.lower().split(), y.lower().split()
            longer = max(len(u), len(v))
            alike = x == y or (
                longer > 0 and min(len(u), len(v)) >= 0.8 * longer and 1 - distance(u, v) / longer >= 0.8
            )
            if alike:
                p, q = root(a), root(b)
                label[max(p, q)] = min(p, q)
    return {d: root(d) for d in texts}


def test_classes_match_all_pairs(spark):
    docs, texts = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(table).collect()}
    assert got == brute(texts)


def chained_family(size):
    """Variants of variants of one text around the threshold, which often share a key."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    family = [[word() for _ in range(100)]]
    while len(family) < size:
        words = list(rng.choice(family))
        start = rng.randrange(100)
        for k in range(rng.randint(12, 24)):
            words[(start + k) % 100] = word()
        family.append(words)
    rng.shuffle(family)
    return [(d, " ".join(words)) for d, words in enumerate(family)]


@pytest.mark.parametrize("joined, block_words", [(neardup.JOINED, neardup.BLOCK_WORDS), (4, 1500), (10**6, 1)])
def test_no_link_of_a_chained_family_is_lost(spark, monkeypatch, joined, block_words):
    monkeypatch.setattr(neardup, "JOINED", joined)
    monkeypatch.setattr(neardup, "BLOCK_WORDS", block_words)
    docs = chained_family(400)
    words = neardup.word_hashes([t for _, t in docs])
    with np.errstate(over="ignore"):
        keys = np.array([neardup.sketch(w) for w in words])
    label = list(range(len(docs)))

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for b in range(len(docs)):
        for a in np.flatnonzero((keys[:b] == keys[b]).any(axis=1)):
            if similarity(words[a], words[b], 0.8) > 0:
                p, q = root(int(a)), root(b)
                label[max(p, q)] = min(p, q)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(table).collect()}
    assert got == {d: root(d) for d, _ in docs}


def test_bands_hold_every_pair_of_close_lengths(spark):
    lengths = list(range(1, 70)) + [127, 128, 159, 160, 255, 256, 319, 320]
    members = spark.createDataFrame([(1, n, n, n) for n in lengths], "key long, id long, n_words long, label long")
    held = neardup._banded(members).collect()
    met = [
        (min(a.id, b.id), max(a.id, b.id))
        for a in held
        for b in held
        if a.band == b.band and a.id < b.id and not (a.guest and b.guest)
    ]
    assert len(met) == len(set(met))  # once each
    close = {(a, b) for a in lengths for b in lengths if a < b and b - a <= int((1.0 - neardup.THRESHOLD) * b + 1e-9)}
    assert close and close <= set(met)


def test_scattered_substitutions_share_a_key():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for alike, least in ((0.95, 1.0), (0.9, 0.97), (0.85, 0.72), (0.8, 0.3)):
        hit = 0
        for _ in range(120):
            one = [word() for _ in range(400)]
            two = list(one)
            for k in rng.sample(range(400), round((1 - alike) * 400)):
                two[k] = word()
            a, b = neardup.word_hashes([" ".join(one), " ".join(two)])
            assert similarity(a, b, 0.8) > 0
            with np.errstate(over="ignore"):
                hit += bool((neardup.sketch(a) == neardup.sketch(b)).any())
        assert hit >= least * 120, (alike, hit)


def test_nulls_repeats_and_extra_columns(spark):
    long_text = " ".join(f"w{i % 997}x{i}" for i in range(30000))
    rows = [
        (1, "a b c d e f g h", "k"), (1, "a b c d e f g h", "k"), (2, None, "k"), (3, "", None),
        (None, "a b c d e f g h", "k"), (None, None, "k"), (7, long_text, "k"), (8, long_text + " end", "k"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    out = neardup.near_duplicate_classes(table).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.class_id) for r in out} == {(1, 1), (2, 2), (3, 2), (None, 1), (None, 2), (7, 7), (8, 7)}
    kept = neardup.drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 7]
    assert neardup.near_duplicate_classes(table.limit(0)).count() == 0
    assert neardup.drop_near_duplicates(table.limit(0)).count() == 0


def test_working_names_and_rows_of_one_id(spark):
    rows = [(1, "a b c d e f", 5), (1, "other words stand here in this one", 6), (2, "a  b c d e F", 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, __kept long")
    kept = neardup.drop_near_duplicates(table)
    assert kept.columns == table.columns
    runs = {tuple(map(tuple, neardup.drop_near_duplicates(table.repartition(n)).collect())) for n in (1, 3, 5)}
    assert len(runs) == 1 and {r[0] for r in next(iter(runs))} == {1}


def test_order_matters():
    words = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    turned = np.concatenate([words[200:], words[:200]])
    same, moved = neardup.sketch(words), neardup.sketch(turned)
    assert (same == neardup.sketch(words.copy())).all()
    # the same shingles in another order share few keys
    assert (same == moved).mean() < 0.6


def test_a_large_key_deals_guests_only_to_bands_in_use(spark):
    # 70 words may be similar to 60, in the band below; under key 1 nobody is there
    rows = [(1, i, 70, i) for i in range(50)] + [(2, i, 70 if i % 5 else 60, i) for i in range(50)]
    banded = neardup._banded(spark.createDataFrame(rows, "key long, id long, n_words long, label long"))
    got = {(r.key, r.band, r.guest): (r["count"], r.total) for r in banded.groupBy("key", "band", "guest", "total").count().collect()}
    assert got == {(1, 7, False): (50, 3500), (2, 7, False): (40, 2800), (2, 6, False): (10, 3400), (2, 6, True): (40, 3400)}
    assert "Generate" not in banded._jdf.queryExecution().executedPlan().toString()
