import collections
import random

from testlog.llm import linededup as ld


def templates(line):
    words = line.split()
    if ld.VARIABLE.search(line):
        words = ["<*>" if ld.VARIABLE.search(w) else w for w in words]
    n = len(words)
    if n < ld.GENERAL:
        return {(n, tuple(words))}
    rest = n - ld.LEADING
    out = set()
    for k in range(ld.FIELDS):
        low, high = ld.LEADING + rest * k // ld.FIELDS, ld.LEADING + rest * (k + 1) // ld.FIELDS
        out.add((n, k, tuple(words[:low]), tuple(words[high:])))
    return out


def brute(docs):
    seen = collections.defaultdict(list)
    for d, text in docs:
        for t in {t for line in (text or "").split("\n") if line.strip() for t in templates(line)}:
            seen[t].append(d)
    first = {t: min(ds) for t, ds in seen.items() if len(ds) >= ld.MIN_DOCS}
    out = {}
    for d, text in docs:
        lines = (text or "").split("\n")
        marks = [line.strip() and any(t in first for t in templates(line)) for line in lines]
        lost = [m and any(first.get(t, d) != d for t in templates(line)) for m, line in zip(marks, lines)]
        copy = any(marks) and sum(len(x) for x, m in zip(lines, marks) if m) >= ld.COPY_SHARE * sum(map(len, lines))
        out[d] = text if copy or not any(lost) else "\n".join(x for x, m in zip(lines, lost) if not m)
    return out


def test_matches_brute_force(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = [line(9), line(3), line(5), "Page {} of 10 shown here to all the readers", "See http://x/{} for more"]
    docs = []
    for d in range(150):
        lines = [line(rng.randint(1, 14)) for _ in range(rng.randint(0, 12))]
        for c in common:
            if rng.random() < 0.3:
                lines.insert(rng.randint(0, len(lines)), c.format(rng.randint(1, 99)))
        docs.append((d, "\n".join(lines)))
    docs.append((900, docs[3][1]))
    docs.append((901, docs[3][1]))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in ld.dedup_lines(table).collect()}
    assert got == brute(docs)


def test_variable_fields_share_a_template(spark):
    docs = [(i, f"unique words number{i} stand here {'x' * i}\nServed to user{i} at 10.0.0.{i} on port 8{i}\n" + f"zzz{'q' * i} " * 40)
            for i in range(1, 7)]
    out = {r.doc_id: r for r in ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert "Served to" in out[1].text
    assert all("Served to" not in out[i].text for i in range(2, 7))


def test_boilerplate_goes_from_pages_that_mostly_consist_of_it(spark):
    shared = ["Subscribe to our weekly letter for more of this", "All rights are reserved by the owners", "Read our terms of use before you go on"]
    docs = [(d, "\n".join([*shared, f"own{'x' * d} text about thing{'y' * d} only told here"])) for d in range(1, 5)]
    assert sum(map(len, shared)) > 0.6 * len(docs[0][1])
    out = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {d: t if d == 1 else t.split("\n")[-1] for d, t in docs}


def test_short_lines_and_lines_of_numbers_recur_too(spark):
    own = "The own line {0} of document {0} is this {0} one {0}"
    docs = [(d, f"Was.\n1 {d} 3 4 5 6 {d} 8 9 10\n{own.format('x' * d)}") for d in range(1, 40)]
    out = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {d: t if d == 1 else t.split("\n")[-1] for d, t in docs}


def test_input_columns_called_as_the_working_ones_stay(spark):
    table = spark.createDataFrame([(1, "x y z", 1, 2, 3, 4)], "doc_id long, text string, __row long, __lines long, __lost long, __CHARS long")
    assert [tuple(r)[:6] for r in ld.dedup_lines(table).collect()] == [(1, "x y z", 1, 2, 3, 4)]


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "\n\n", "c"), (3, "\n\n", "c"), (None, "x y z\nlong tail of text", "d"), (5, "w " * 50000, "e")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    out = ld.dedup_lines(table)
    assert out.columns == ["doc_id", "text", "n_lines", "n_recurring", "n_dropped", "is_copy"]
    assert sorted((str(r.doc_id), r.text) for r in out.collect() if r.text) == sorted(
        (str(d), t) for d, t, _ in rows if t
    )
    assert out.count() == 6
    assert ld.dedup_lines(table.limit(0)).count() == 0
