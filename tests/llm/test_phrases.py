import random
import re
from collections import Counter

from testlog.llm import phrases


def brute(rows, min_count, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase by itself."""
    counts = {}
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        own[tuple(words[i : i + k])] += 1
    out = []
    for lang, own in counts.items():
        n = sum(c for g, c in own.items() if len(g) == 1)
        held = [g for g, c in own.items() if len(g) > 1 and c >= min_count]
        dropped = {
            g[i : i + k] for g in held for k in range(2, len(g)) for i in range(len(g) - k + 1) if own[g] >= own[g[i : i + k]]
        }
        scored = []
        for g in held:
            if g in dropped:
                continue
            score, k = min((1000 * own[g] * n // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -own[g], " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def mined(spark, rows, min_count, top):
    docs = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n long, phrase string")
    found = phrases.collocations(docs.repartition(5), min_count, top)
    return sorted(tuple(r) for r in found.collect())


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["the", "of", "Off", "a\x01", "a", "a\x1f", "é", "\x00", "ż x", "aa", "b-c", "\x7f"]
    rows = []
    for _ in range(300):
        words = rng.choices(vocabulary, k=rng.randrange(12))
        if rng.random() < 0.3:
            words[1:1] = "one fixed phrase of six words".split()
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for w in words)
        rows.append((rng.choice([text, text.upper(), None, ""]), rng.choice(["en", "en", None, "und", "fr"])))
    rows += [rows[0]] * 20
    # texts are cut into many parts, and windows leave a task a few at a time
    monkeypatch.setattr(phrases, "PART", 9)
    monkeypatch.setattr(phrases, "HELD", 40)
    monkeypatch.setattr(phrases, "PAIRS", 50)
    expected = brute(rows, 4, 1000)
    assert len(expected) > 30 and mined(spark, rows, 4, 1000) == expected
    assert mined(spark, rows, 4, 3) == [r for r in expected if r[1] <= 3]


def test_a_phrase_over_many_partitions(spark):
    # most windows begin with one pair of words, so its flow comes from several partitions
    rng = random.Random(6)
    rows = [(f"hot pair w{rng.randrange(3000)} w{rng.randrange(3000)}", "en") for _ in range(4000)]
    dealt = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert mined(spark, rows, 3, 500) == brute(rows, 3, 500)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", dealt)


def test_unary_paths_and_large_numbers(spark):
    rows = [("a b c d e f", "en")] * 5 + [("a b", "en")]
    found = {r[2] for r in mined(spark, rows, 5, 10)}
    assert found == {"a b", "a b c d e", "b c d e f"}
    # 1000 * a * n passes 64 bits
    docs = spark.createDataFrame([("a b", "en")], "text string, lang string")
    counts = docs.selectExpr("lang", "explode(array('a', 'b', 'a b', '')) AS phrase").selectExpr(
        "lang", "phrase", "IF(phrase = '', 0, size(split(phrase, ' '))) AS length", "9000000000000L AS n"
    )
    original = phrases.phrase_counts
    phrases.phrase_counts = lambda *_: counts
    try:
        assert phrases.collocations(docs).first().score == 1000
    finally:
        phrases.phrase_counts = original


def test_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(phrases, "PART", 10)
    for text in (b"a b c d e f g h i j k l m n", b"abcdefghijklmnop qrstuvwxyzabcdef g\nh i", b"", b"x" * 50, b"aa\nbb " * 9):
        found, low = [], 0
        for part, own in phrases._parts(text):
            assert text[low:].startswith(part)
            behind = part[own:].split()
            assert len(behind) >= min(phrases.LONGEST - 1, len(text[low + own :].split()))
            found += part[:own].split()
            low += own
        assert found == text.split()


def test_nothing_to_count(spark):
    assert mined(spark, [("", "en"), (None, None), ("?! ,", "fr")], 1, 10) == []
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(empty).count() == 0
