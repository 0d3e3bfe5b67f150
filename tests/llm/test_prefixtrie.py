import hashlib
import random
import zlib

import pytest

from testlog.llm import prefixtrie as pt

SCHEMA = "conv_id long, turn int, role string, text string, k1 string, part string, order_x int"


def brute(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = int(c / 5) * 5
        made[c] = turns if base == c else own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    totals = {}
    for path in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        below = [totals[x] for x in kids.get(path, [])]
        totals[path] = (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))
    out = []
    for path, convs in nodes.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(made[c]) == len(path))))
        above = min(nodes[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(path), above, len(convs), len(kids.get(path, [])), *totals[path], digest))
    return out


def found(spark, rows):
    turns = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(6)
    return [tuple(r) for r in pt.prefix_trie(turns).collect()]


def same(left, right):
    assert sorted(map(str, left)) == sorted(map(str, right))


@pytest.fixture
def many_shards(spark):
    # small tables are dealt over all partitions, so that totals pass through many shards
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def test_equals_brute_force(spark, many_shards, monkeypatch):
    monkeypatch.setattr(pt, "QUEUE", 3)
    monkeypatch.setattr(pt, "ROWS", 7)
    monkeypatch.setattr(pt, "BLOCK", 3)
    monkeypatch.setattr(pt, "FEWER", 2)
    rng = random.Random(1)
    texts = ["hi", "", None, "é", "a b", "long " * 30]
    rows = []
    for c in rng.sample(range(-40, 400), 150):
        common = rng.random() < 0.4
        for turn in range(rng.randrange(1, 14)):
            text = "hi" if common and turn < 5 else rng.choice(texts)
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "user", "assistant", None]), text))
    rows += [(None, 1, "user", "lost")] * 5 + rows[:20]
    for c in range(1000, 1400):  # one conversation again and again
        rows += [(c, t, "user", "same") for t in range(12)]
    same(found(spark, rows), brute(rows))


def test_a_conversation_over_many_partitions(spark, many_shards):
    rng = random.Random(2)
    rows = [(5, t, "user", str(rng.random())) for t in range(3000)]
    rows += [(6, t, "user", "x") for t in range(20)] + [(7, None, "a", "same")] * 900 + [(2 * t, 0, "user", "x") for t in range(10, 300)]
    same(found(spark, rows), brute(rows))


def test_queue_spills_in_order():
    rng = random.Random(3)
    queue, held = pt.MessageQueue(5), []
    for _ in range(400):
        if rng.random() < 0.6 or not held:
            m = tuple(rng.randrange(-9, 9) for _ in range(6))
            queue.push(m)
            held.append(m)
        else:
            held.remove(min(held)) if queue.first() == min(held) == queue.pop() else pytest.fail("order")
    assert queue.made > 3
    assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.first() is None


def test_turnless_and_empty(spark):
    loose = next(c for c in range(11, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(loose, 0, "user", "gone")]
    assert found(spark, rows) == [(loose, 0, None, 1, 0, 1, 0, hashlib.sha256(str(loose).encode()).hexdigest())]
    same(found(spark, rows), brute(rows))
    assert found(spark, [(None, 1, "user", "x")]) == [] and found(spark, []) == []
