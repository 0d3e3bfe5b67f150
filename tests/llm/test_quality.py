import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from testlog.llm import quality as q


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    count = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {p for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)
    )


def test_measures_match_brute_force(spark):
    rng = random.Random(9)
    words = ["the", "of", "a", "#x", "é|", "A1", " ", "x<y", "b", "😀", "\t"]
    docs = []
    for d in range(250):
        parts = [rng.choice(words[: rng.randint(2, 11)]) for _ in range(rng.randint(0, 120))]
        docs.append((d, "".join(p + rng.choice([" ", "\n", "  ", "\r\n", "\x0b"]) for p in parts), rng.choice(["en", "de", "xx", None])))
    docs += [(900, None, "en"), (901, "", None), (902, "\n\n \t", "fr"), (903, "a b c " * 20000, "en"), (903, "a b c " * 20000, "en")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    out = q.quality_rows(table).collect()
    assert len(out) == len(docs)
    expected = {d: measures(t) for d, t, _ in docs}
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected[r.doc_id], r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_windows_that_share_a_hash_are_told_apart(spark, monkeypatch):
    rng = random.Random(12)
    docs = [(d, " ".join(rng.choice("abcde") for _ in range(rng.choice([0, 1, 2, 3, 4, 40, 90])))) for d in range(120)]
    docs.append((500, " ".join(f"w{i}" for i in range(400)) + " w7 w8 w9"))
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("en"))
    for hashed in ("pmod(xxhash64(w), 5)", "pmod(xxhash64(w), 400)", "0L"):
        monkeypatch.setattr(q, "WINDOW_HASH", hashed)
        got = {r.doc_id: r.n_repeat_words for r in q.measure(table).select("doc_id", "n_repeat_words").collect()}
        assert got == {d: measures(t)[4] for d, t in docs}


def test_distance(spark):
    def js(p, r):
        part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
        return math.sqrt(sum(part(a, b) + part(b, a) for a, b in zip(p, r)) / 2)

    pairs = [([0.5, 0.5, 0.0], [0.2, 0.3, 0.5]), ([1.0, 0.0], [0.0, 1.0]), ([0.3, 0.7], [0.3, 0.7])]
    out = spark.createDataFrame([(p, r) for p, r in pairs], "p array<double>, r array<double>")
    got = [row.d for row in out.select(q.js_distance("p", "r").alias("d")).collect()]
    assert got == pytest.approx([js(p, r) for p, r in pairs], abs=1e-7)


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(10)
    common = q.COMMON_WORDS["en"]

    def prose(n):
        words = [rng.choice(common) if rng.random() < 0.35 else "".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(n)]
        return ". ".join(" ".join(words[i : i + 12]).capitalize() for i in range(0, n, 12))

    good = [(i, prose(rng.randint(60, 400)), "en", "x") for i in range(80)]
    symbols = [(100 + i, prose(200).replace(" ", "%%% "), "en", "x") for i in range(4)]
    strange = [(200 + i, " ".join("".join(rng.choice("bcdfgk") for _ in range(6)) for _ in range(200)), "en", "x") for i in range(4)]
    table = spark.createDataFrame(good + symbols + strange, "doc_id long, text string, lang string, kept string")
    kept = q.keep_good(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(80))
    assert q.keep_good(table.limit(0)).count() == 0
    assert q.quality_rows(table.filter(F.lit(False))).count() == 0
