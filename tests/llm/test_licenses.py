import random
import re

from testlog.llm import licenses as lc


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = words_of(text)
    starts, base = [], set()
    for phrase, label in lc.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                base.add(label)
    labels, score = set(base), 0.0
    for b in range(-1, len(w) // lc.STRIDE + 1):
        block = set(w[max(0, b * lc.STRIDE) : (b + 2) * lc.STRIDE])
        for label, notice in lc.TEMPLATES:
            t = lc.template_words(notice)
            share = len(block & set(t)) / len(t)
            if len(block & set(t)) >= lc.needed(len(t)):
                labels.add(label)
                score = max(score, share)
    return (
        len(w), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9),
    )


def test_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = sorted({w for _, t in lc.TEMPLATES for w in lc.template_words(t)}) + ["Éa", "xyz", "MIT", "It's"]
    docs = []
    for d in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        if d % 3 == 0:
            notice = lc.TEMPLATES[d % len(lc.TEMPLATES)][1].split()
            if d % 2:
                notice.pop(rng.randrange(len(notice)))
            words[10:10] = notice
        docs.append((d, rng.choice([" ", "\n", ", "]).join(words)))
    docs += [
        (900, None), (901, ""), (902, "MIT License MIT license, mit-license"), (903, "permit license mit licenses"),
        (904, "GNU General Public\nLicense general public license"), (905, "license apache license"),
        (906, "w " * 60000 + "Released under the MIT License."),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {
        r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))
        for r in lc.scan(table).collect()
    }
    assert got == {d: brute(t) for d, t in docs}


def test_edges(spark):
    rows = [(1, "Released under the MIT License", "x")] * 2 + [(None, "Licensed under CC BY-NC 4.0", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    assert sorted((r.doc_id or 0, r.labels) for r in lc.scan(table).collect()) == [(0, "cc-by-nc"), (1, "mit"), (1, "mit")]
    assert lc.scan(table.limit(0)).count() == 0
