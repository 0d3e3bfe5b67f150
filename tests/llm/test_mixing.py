import random
from fractions import Fraction

import pytest

from testlog.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, epoch long, __mix_key long"


def poured(sizes, weights, epochs):
    """Targets by resharing the excess of clamped sources again and again, in fractions."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        goal = {s: Fraction(left * weight[s], sum(weight[x] for x in free)) for s in free}
        above = [s for s in free if goal[s] > epochs * sizes[s]]
        if not above:
            return fixed | goal
        fixed |= {s: epochs * sizes[s] for s in above}


def rows_of(rng, n):
    names = ["src1", "src10", "src2", "Ä", "z", None, "", "tiny"]
    shares = [30, 1, 5, 3, 2, 2, 1, 1]
    out = []
    for i in range(n):
        words = ["w"] * rng.choice([0, 1, 5, 40, 300])
        text = rng.choice(["", " ", "\t"]) + rng.choice([" ", "\n", "\v "]).join(words) if rng.random() < 0.97 else None
        out.append((i if rng.random() < 0.95 else None, text, rng.choices(names, shares)[0], "s", 9, 1))
    return out + [out[3]] * 40


@pytest.mark.parametrize("weights, epochs", [((5, 2, 1), 3), ((1, 7), 2), ((1,), 1)])
def test_targets_and_taken_words(spark, weights, epochs):
    rows = rows_of(random.Random(3), 700)
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(docs, weights, epochs).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    goal = poured(sizes, weights, epochs)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert 0 <= r.taken <= epochs * r.size
        if r.size:  # all whole repetitions, and at most one more
            assert 0 <= r.taken - int(r.target // r.source_size) * r.size <= r.size
        taken[r.source] += r.taken
    for s in sizes:  # equal rows at the border share it, rounded down
        words = int(goal[s] + Fraction(1, 2))
        assert words - 41 <= taken[s] <= words
    again = mixing.mix(docs.repartition(7), weights, epochs).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(again, key=key)
    other = mixing.mix(docs, weights, epochs, seed=1).collect()
    assert weights == (1,) or sorted(found, key=key) != sorted(other, key=key)


def test_the_mix_itself(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 9)), "ab"[i % 5 == 0], "s", 9, 1) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    words, epochs = dict.fromkeys(taken, 0), {}
    for r in mixing.repetitions(docs).collect():
        assert rows[r.doc_id][1].startswith(r.text) and r.size == "s"
        words[r.doc_id] += len(r.text.split())
        epochs.setdefault(r.doc_id, []).append(r.epoch)
    assert words == taken and set(docs.columns) - {"__mix_key"} == set(mixing.repetitions(docs).columns)
    assert all(sorted(e) == list(range(1, len(e) + 1)) for e in epochs.values())


def test_no_words_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, " ", None)], "doc_id long, text string, source string")
    assert sorted((r.size, r.source_size, r.target, r.taken) for r in mixing.mix(docs).collect()) == [(0, 0, 0.0, 0)] * 2
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.repetitions(docs).count() == 0
