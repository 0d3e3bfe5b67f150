import itertools
import random

from testlog.llm import decontam


def make():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, [word() for _ in range(rng.randint(1, 60))]) for i in range(40)]
    docs, bad = [], set()
    for d in range(200):
        words = [word() for _ in range(rng.randint(0, 300))]
        if d % 4 == 0:
            item, text = items[rng.randrange(40)]
            text = list(text)
            for k in range(5, len(text), 11):  # one substitution in eleven words
                text[k] = word()
            at = rng.randint(0, len(words))
            words[at:at] = text
            if len(text) >= decontam.TOLERANT or decontam.MIN_WORDS <= len(text) <= 5:
                bad.add((d, item))
        elif d % 4 == 1:  # a few words only
            words[0:0] = items[d % 40][1][:5]
        docs.append((d, " ".join(words)))
    return docs, [(i, " ".join(w).upper()) for i, w in items], bad


def brute(docs, items):
    found = set()
    for d, text in docs:
        t = decontam.WORD.findall((text or "").lower())
        for i, item in items:
            w = decontam.WORD.findall((item or "").lower())
            n = min(len(w), decontam.STRETCH)
            if len(w) < decontam.MIN_WORDS:
                continue
            if any(
                sum(a == b for a, b in zip(w[k : k + n], t[s : s + n])) >= decontam.needed(n) * n
                for k in range(len(w) - n + 1)
                for s in range(len(t) - n + 1)
            ):
                found.add((d, i))
    return found


def test_finds_passages_with_substitutions(spark):
    docs, items, bad = make()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(table, bench).collect()}
    assert bad <= got
    assert got == brute(docs, items)


def test_edges(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame(
        [(1, text, 1), (1, text, 1), (None, f"x {text} y", 2), (3, None, 3), (4, "", 4), (5, "w " * 40000, 5)],
        "doc_id long, text string, row_key long",
    )
    bench = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "too short"), (None, text)], "item_id long, text string")
    out = decontam.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(d, i) for d in (1, None) for i in (1, 2, None)}
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == 6
    assert decontam.contaminated(docs.limit(0), bench).count() == 0


def test_items_of_few_words_are_found_whole(spark):
    items = [(n, " ".join(f"item{n}word{k}" for k in range(n))) for n in range(1, 8)]
    docs = [(n, f"before {text.upper()}, after") for n, text in items]
    docs += [(10 + n, " ".join(text.split()[:-1] + ["other"])) for n, text in items]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontam.contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(n, n) for n in range(3, 8)}


def test_an_input_column_called_as_the_working_one_stays(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, text, 7, 8), (2, "clean", 5, 6)], "doc_id long, text string, __row long, ___ROW long")
    kept = decontam.drop_contaminated(docs, spark.createDataFrame([(1, text)], "item_id long, text string"))
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "clean", 5, 6)]


def test_short_items_with_every_allowed_substitution(spark):
    items, docs, wanted = [], [], set()
    for n in range(8, 13):
        words = [f"item{n}word{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for gone in itertools.combinations(range(n), n // 5):
            text = ["other" if k in gone else w for k, w in enumerate(words)]
            wanted.add((len(docs), n))
            docs.append((len(docs), " ".join(["before"] * 5 + text + ["after"] * 5)))
        for gone in itertools.combinations(range(n), n // 5 + 1):
            docs.append((len(docs), " ".join("other" if k in gone else w for k, w in enumerate(words))))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontam.contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted
